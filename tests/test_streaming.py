"""Streams over several files, one file per micro-batch, against the batch result."""

import datetime as dt
import json
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallywatch import session
from tallywatch.streaming import jobs
from tallywatch.streaming.verdicts import Verdicts, by_facet
from test_rules import AS_OF, matches

T0 = dt.datetime(2026, 2, 1)
SCHEMA = "log_id string, source_id string, level string, message string, ts timestamp"


@pytest.fixture()
def feed(spark, tmp_path):
    """Write each list of (id, source, level, minute) as one file; read them one by one."""
    def make(*files):
        for i, rows in enumerate(files):
            data = [(a, s, lv, "m", T0 + dt.timedelta(minutes=m)) for a, s, lv, m in rows]
            spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"part={i}"))
        source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
        return source.parquet(str(tmp_path / "in"))
    return make


def test_tumbling_counts_over_batches(feed):
    stream = feed([("1", "a", "error", 1), ("2", "a", "info", 59)], [("3", "a", "fatal", 61), ("4", "b", "info", 62)], [("5", "a", "info", 200)])
    rows = jobs.run_to_table(jobs.stream_tumbling_counts(stream), "t").collect()
    got = {(r["bucket_start"].hour, r["source_id"]): (r["n"], r["errors"]) for r in rows}
    assert got == {(0, "a"): (2, 1), (1, "a"): (1, 1), (1, "b"): (1, 0)}


def test_dedupe_over_batches(feed):
    rows = [("1", "a", "info", 1), ("2", "a", "info", 2)]
    stream = feed(rows, rows, [("3", "a", "info", 3)])
    out = jobs.stream_dedupe(stream.withColumn("raw_content", F.concat_ws(" ", "ts", "message"))).select("log_id", "source_id")
    assert sorted(r["log_id"] for r in jobs.run_to_table(out, "d").collect()) == ["1", "2", "3"]


def test_sessions_span_batches(feed):
    stream = feed([("1", "a", "info", 0), ("2", "a", "info", 5)], [("3", "a", "info", 12)], [("4", "a", "info", 100)])
    rows = jobs.run_to_table(jobs.stream_sessions(stream), "s").collect()
    assert [(r["start_ts"].minute, r["end_ts"].minute, r["n"]) for r in rows] == [(0, 22, 3)]


RULES = ("id string, name string, description string, source_id string, status string, severity string, "
         "conditions string, actions string, cooldown_minutes int, last_triggered_at timestamp_ntz, trigger_count long")


def rules_of(spark, *rows):
    return spark.createDataFrame(
        [(i, "n", None, source, status, "high", json.dumps(conds), "[]", cooldown, None, 0) for i, source, status, cooldown, conds in rows], RULES)


def ask(kind, **params):
    return {"type": kind, "params": params}


def some_rules(spark, fraction=0.0):
    return rules_of(
        spark, ("own", "a", "enabled", 7, [ask("error_count", threshold=2, timeWindowMinutes=5 + fraction)]),
        ("all", None, "enabled", 3, [ask("error_rate", threshold=0.4, timeWindowMinutes=20)]),
        ("words", None, "enabled", 1, [ask("keyword_match", keywords=["Disk", "disk", "x"], timeWindowMinutes=3), ask("log_level", levels=["error"])]),
        ("both", "b", "enabled", 15, [ask("keyword_match", keywords=["DISK", "full"], matchAll=True, timeWindowMinutes=60)]),
        ("quiet", "b", "enabled", 30, [ask("no_logs", timeWindowMinutes=10)]), ("none", "zz", "enabled", 40, [ask("no_logs")]),
        ("always", None, "enabled", 100, []), ("never", None, "enabled", 5, [ask("custom")]), ("off", None, "disabled", 5, []))


def some_logs(n=120):
    rng = random.Random(17)
    minutes = sorted(rng.choice([rng.uniform(0, 300), rng.randrange(0, 300)]) for _ in range(n))
    return [(f"l{i}", rng.choice("aab"), rng.choice(["info", "error", "fatal"]), m, rng.choice(["disk", "disk FULL", "ok"])) for i, m in enumerate(minutes)]


def batch_of(spark, rows):
    data = [(a, s, lv, text, T0 + dt.timedelta(minutes=m)) for a, s, lv, m, text in rows]
    return spark.createDataFrame(data, SCHEMA).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@pytest.fixture()
def texts(spark, tmp_path):
    """Like ``feed``, with messages, and with a name for each folder of files."""
    def make(name, *files):
        for rows in files:
            batch_of(spark, rows).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    return make


def horizon(rows, grain=60):
    """The last minute a stream of these rows can judge."""
    return int((int(max(r[3] for r in rows) * 60_000) / 1000 - 600 - grain) // 60)


@pytest.mark.parametrize("fraction", [0.0, 0.5])
def test_verdicts_and_triggers_do_not_depend_on_the_batches(spark, texts, fraction):
    rows, rules = some_logs(), some_rules(spark, fraction)
    upto = horizon(rows, 60 if not fraction else 1)
    want = {}
    for step in range(upto + 1):
        logs = [(i, source, level, text, AS_OF + dt.timedelta(minutes=m - step)) for i, source, level, m, text in rows]
        for r in rules.filter("status = 'enabled'").collect():
            want[r["id"], step] = all(matches({"logs": logs, "source": r["source_id"]}, c)[0] for c in json.loads(r["conditions"]))
    triggers, pauses = [], {r["id"]: r["cooldown_minutes"] for r in rules.collect()}
    for k in pauses:
        free = 0
        for step in range(upto + 1):
            if want.get((k, step)) and step >= free:
                triggers.append((k, T0 + dt.timedelta(minutes=step)))
                free = step + pauses[k]
    triggers.sort()
    assert len({r for r, _ in triggers}) >= 6
    cut = [rows[:1], rows[1:50], rows[50:51], rows[51:90], rows[90:]]
    for name, files in (("one", [rows]), ("many", cut)):
        changes = jobs.run_to_table(jobs.stream_rules(texts(f"{name}-r", *files), rules, T0), "r").collect()
        series = {}
        for r in sorted(changes, key=lambda r: r["as_of"]):
            series.setdefault(r["rule_id"], []).append(((r["as_of"] - T0) // dt.timedelta(minutes=1), r["triggered"]))
        # Each series begins at the first step, and alternates.
        assert all(s[0][0] == 0 and all(x[1] != y[1] for x, y in zip(s, s[1:])) for s in series.values())
        assert {(k, step): [v for m, v in series[k] if m <= step][-1] for k, step in want} == want
        got = jobs.run_to_table(jobs.stream_cooldown(texts(f"{name}-c", *files), rules, T0), "c").collect()
        assert sorted((r["rule_id"], r["triggered_at"]) for r in got) == triggers


def test_a_trigger_holds_its_cooldown_over_a_restart(spark, texts, tmp_path):
    rules = rules_of(spark, ("r", None, "enabled", 60, [ask("error_count", threshold=1, timeWindowMinutes=5)]))
    folder = str(tmp_path / "cool")
    for at, want in ((0, []), (30, [0]), (200, [0]), (300, [0, 200])):
        stream = texts("again", [(f"e{at}", "a", "error", at, "m"), (f"i{at}", "b", "info", at + 1, "m")])
        got = jobs.run_to_table(jobs.stream_cooldown(stream, rules, T0), "cool", folder).collect()
        assert sorted((r["triggered_at"] - T0) // dt.timedelta(minutes=1) for r in got) == want


def test_rules_of_a_scope_share_their_counts(spark, texts):
    conds = [ask("error_count", threshold=2, timeWindowMinutes=5)]
    rules = rules_of(spark, *((f"r{i}", None, "enabled", 1 + i % 3, conds) for i in range(40)), ("other", "a", "enabled", 1, conds))
    parsed = session.materialize(jobs.parse_rules(rules), "shared-rules")
    specs = jobs.rule_specs(parsed).collect()
    assert len(specs) == 41 and len({(r["part"], r["spec"]) for r in specs}) == 2
    rows = some_logs()
    changes = jobs.run_to_table(jobs.stream_rules(texts("shared", rows[:50], rows[50:]), rules, T0), "shared").collect()
    series = {}
    for r in changes:
        series.setdefault(r["rule_id"], set()).add((r["as_of"], r["triggered"]))
    assert len(series) == 41 and len(series["r0"]) > 2 and all(series[f"r{i}"] == series["r0"] for i in range(40))
    # A rule row that comes twice is told once.
    twice = jobs.run_to_table(jobs.stream_rules(texts("twice", rows), rules.union(rules), T0), "twice").collect()
    assert len(twice) == len(set(twice))


def test_met_steps_are_handed_on_as_runs():
    runs = Verdicts._met_runs(np.array([0, 2, 5, 9, 11]), np.array([True, True, False, True, True]), 20)
    assert runs.to_numpy().tolist() == [[0, 4], [9, 20]]
    assert not len(Verdicts._met_runs(np.array([0, 3]), np.array([False, False]), 7))
    cells = by_facet(pd.DataFrame({"facet": ["a", "b", "a"], "base": [1, 2, 3], "after": [0, 1, 0], "n": [5, 6, 7]}))
    assert {f: v.tolist() for f, v in cells.items()} == {"a": [[1, 3], [0, 0], [5, 7]], "b": [[2], [1], [6]]}
    assert by_facet(pd.DataFrame({"facet": [], "base": [], "after": [], "n": []})) == {}


def test_equal_rules_are_handed_on_in_bunches():
    rules = [[f"r{i}", 5] for i in range(70)] + [["slow", 9], [None, 9]]
    told = Verdicts(0, 1, 1, True)._told(rules, pd.DataFrame({"step": [1, 8], "last": [3, 9]}))
    ids = [(json.loads(r), p) for r, p in zip(told["rules"], told["pause"])]
    assert [(len(r), p) for r, p in ids[::2]] == [(32, 5), (32, 5), (6, 5), (2, 9)] and ids[::2] == ids[1::2]
    assert [[r, p] for bunch, p in ids[::2] for r in bunch] == rules
    assert told[["step", "last"]].to_numpy().tolist() == [[1, 3], [8, 9]] * 4


def test_a_stream_has_no_more_state_partitions_than_cores(spark, feed, tmp_path):
    asked = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        jobs.run_to_table(jobs.stream_tumbling_counts(feed([("1", "a", "error", 1)], [("2", "a", "info", 200)])), "t", str(tmp_path / "kept"))
        assert spark.conf.get("spark.sql.shuffle.partitions") == "50"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", asked)
    stores = [p for p in (tmp_path / "kept" / "checkpoint" / "state" / "0").iterdir() if p.name.isdigit()]
    assert len(stores) == max(jobs.LEAST_PARTITIONS, spark.sparkContext.defaultParallelism)


def test_silence_is_told_without_a_row_of_the_source(spark, texts):
    rows = [("1", "a", "info", 0, "m"), ("2", "b", "info", 1, "m"), ("3", "b", "info", 30, "m"), ("4", "b", "info", 60, "m"), ("5", "d", "info", 61, "m"),
            ("6", "b", "info", 90.001, "m"), ("7", "b", "info", 120, "m"), ("8", "a", "info", 130, "m"), ("9", "b", "info", 140, "m"), ("10", "b", "info", 170, "m"),
            ("11", "b", "info", 190, "m")]
    sources = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "id string")
    minutes = lambda t: None if t is None else round((t - T0).total_seconds() / 60, 3)
    want = [("a", 0, 30), ("a", 130, 160), ("b", 60, 90), ("c", None, 30), ("d", None, 30), ("d", 61, 91)]
    for name, files in (("one", [rows]), ("many", [[r] for r in rows])):
        told = jobs.run_to_table(jobs.stream_silence(texts(name, *files), sources, 30, T0), "s").collect()
        assert sorted(((r["source_id"], minutes(r["last_ts"]), minutes(r["as_of"])) for r in told), key=str) == sorted(want, key=str)


def test_sources_are_read_again_for_each_batch(spark, tmp_path):
    def add(name, ip):
        row = [(name, "syslog", json.dumps({"syslogIp": ip}), T0)]
        spark.createDataFrame(row, "id string, type string, config string, created_at timestamp_ntz").write.mode("append").parquet(str(tmp_path / "sources"))

    def send(i, ip):
        spark.createDataFrame([(str(i), ip, "udp")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "messages"))

    def run():
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "messages"))
        rows = jobs.run_source_refresh(stream, lambda: spark.read.parquet(str(tmp_path / "sources")), folder=str(tmp_path / "run"))
        return {r["message_id"]: r["source_id"] for r in rows.collect()}

    schema = "message_id string, sender_ip string, transport string"
    add("one", "10.0.0.1")
    send(1, "10.0.0.2")
    assert run() == {"1": "unregistered:10.0.0.2"}
    add("two", "10.0.0.2")
    send(2, "10.0.0.2")
    assert run() == {"1": "unregistered:10.0.0.2", "2": "two"}


def test_sender_map_joins_a_stream(spark, tmp_path):
    schema = "message_id string, raw string, sender_ip string, transport string, received_at timestamp_ntz"
    spark.createDataFrame([("m1", "x", "1.1.1.1", "udp", T0), ("m2", "x", "2.2.2.2", "udp", T0)], schema).write.parquet(str(tmp_path / "m"))
    sources = spark.createDataFrame([("a", "syslog", '{"ip":"1.1.1.1"}', T0)], "id string, type string, config string, created_at timestamp_ntz")
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "m"))
    out = jobs.run_to_table(jobs.stream_syslog_sources(stream, sources).select("message_id", "source_id"), "senders")
    assert {tuple(r) for r in out.collect()} == {("m1", "a"), ("m2", "unregistered:2.2.2.2")}


def test_shared_folder_comes_from_the_session(tmp_path):
    class Fake:
        def __init__(self, **values):
            self.values = values
            self.conf = self

        def get(self, name, default=None):
            return self.values.get(name, default)

    named = Fake(**{"spark.checkpoint.dir": "/shared/x/", "spark.master": "yarn"})
    assert session.shared_dir(named, "t").startswith("/shared/x/t-")
    bare = Fake(**{"spark.master": "yarn", "spark.sql.warehouse.dir": "/shared/warehouse"})
    assert session.shared_dir(bare, "t").startswith("/shared/warehouse/_work/t-")
