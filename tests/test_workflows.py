"""Stored tables and the recurring jobs that write them."""

import datetime as dt
import json
import os

import pytest

from tallywatch.operators import workflows
from tallywatch.sources.sinks import Store, Table
from test_rules import AS_OF, LOG_SCHEMA, RULE_SCHEMA, cond, log, rule

SOURCES = "id string, owner_id string, name string, type string, status string, config string, created_at timestamp_ntz"


def frame(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v long")


def values(table):
    return sorted(r.v for r in table.read("v long").collect())


def test_batches_are_added_once(spark, tmp_path):
    table = Table(spark, str(tmp_path / "t"))
    assert values(table) == [] and table.batches() == set()
    with pytest.raises(ValueError, match="nothing written"):
        table.read()
    assert table.append("one", frame(spark, 1, 2)) and table.append("two", frame(spark, 3))
    assert not table.append("one", frame(spark, 9))
    assert values(Table(spark, str(tmp_path / "t"))) == [1, 2, 3]


def test_a_batch_cut_short_is_no_part_of_the_table(spark, tmp_path):
    table = Table(spark, str(tmp_path / "t"))
    table.append("one", frame(spark, 1))
    frame(spark, 7).write.parquet(str(tmp_path / "t" / "data" / "two-unfinished"))
    (tmp_path / "t" / "commits" / "abc.draft").write_text('{"da')
    assert values(table) == [1] and table.append("two", frame(spark, 2)) and values(table) == [1, 2]
    table.clean()
    assert values(table) == [1, 2] and len(os.listdir(tmp_path / "t" / "data")) == 2


def test_compaction_keeps_rows_and_memory_of_batches(spark, tmp_path):
    table = Table(spark, str(tmp_path / "t"))
    for i in range(5):
        table.append(f"b{i}", frame(spark, i))
    old = table.read()
    table.compact()
    assert values(table) == [0, 1, 2, 3, 4] and len(table.commits()) == 1
    assert old.count() == 5  # a reader of the old data is not disturbed
    assert not table.append("b3", frame(spark, 99)) and table.append("b5", frame(spark, 5))
    table.compact()
    table.clean()
    assert values(table) == [0, 1, 2, 3, 4, 5] and table.batches() == {f"b{i}" for i in range(6)}
    assert len([n for n in os.listdir(tmp_path / "t" / "data") if not n.startswith(".")]) == 1


def test_rule_loop_keeps_cooldowns_and_changes_nothing_twice(spark, tmp_path):
    held = Store(spark, str(tmp_path))
    rules = spark.createDataFrame([
        rule("often", [cond("error_count", threshold=1, timeWindowMinutes=60)], cooldown=1),
        rule("seldom", [cond("error_count", threshold=1, timeWindowMinutes=60)], "a", cooldown=30),
        rule("never", [cond("log_level", levels=["debug"])]), rule("broken", [cond("magic")]), rule("off", [], status="disabled")], RULE_SCHEMA)
    logs = spark.createDataFrame([log("e1", 50, "error"), log("e2", 20, "error"), log("i", 1)], LOG_SCHEMA)
    sources = spark.createDataFrame([], SOURCES)
    for minutes in (40, 20, 0, 0):
        workflows.rule_run(rules, logs, sources, held, AS_OF - dt.timedelta(minutes=minutes))
    at = lambda m: AS_OF - dt.timedelta(minutes=m)
    alerts = sorted((r["rule_id"], r["created_at"], r["metadata"]["matchedLogCount"]) for r in held["alerts"].read().collect())
    assert alerts == [("often", at(40), 1), ("often", at(20), 2), ("often", at(0), 2), ("seldom", at(40), 1), ("seldom", at(0), 2)]
    assert held["alert_logs"].read().count() == 8 and held["tickets"].read().count() == 5
    state = {r["rule_id"]: (r["last_triggered_at"], r["trigger_count"]) for r in held["rule_stats"].read().filter(f"run like '{AS_OF:%Y%m%d%H%M}%'").collect()}
    assert state == {"often": (at(0), 3), "seldom": (at(0), 2), "never": (None, 0), "off": (None, 0)}


def test_logs_behind_rules_that_ask_alike_are_stored_once(spark, tmp_path):
    held = Store(spark, str(tmp_path))
    assert held["alert_logs"].read("alert_id string, log_id string").count() == 0
    same = [cond("error_count", threshold=1, timeWindowMinutes=60)]
    rules = spark.createDataFrame([*(rule(f"r{i}", same, cooldown=1) for i in range(20)), rule("own", same, "a", cooldown=1),
                                   rule("empty", [], cooldown=1), rule("quiet", same, "none", cooldown=1)], RULE_SCHEMA)
    logs = spark.createDataFrame([*(log(f"e{i}", i + 1, "error", source="ab"[i % 2]) for i in range(10)), log("old", 70, "error"), log("i", 1)], LOG_SCHEMA)
    sources = spark.createDataFrame([], SOURCES)
    stamp = lambda at: f"{at:%Y%m%d%H%M%S%f}"
    want = set()
    for at, every, own in ((AS_OF - dt.timedelta(minutes=6), range(5, 10), (6, 8)), (AS_OF, range(10), range(0, 10, 2))):
        workflows.rule_run(rules, logs, sources, held, at)
        want |= {(f"alert-r{i}-{stamp(at)}", f"e{k}") for i in range(20) for k in every} | {(f"alert-own-{stamp(at)}", f"e{k}") for k in own}
    table = held["alert_logs"]
    got = lambda: sorted(map(tuple, table.read().collect()))
    written = lambda: sum(spark.read.parquet(str(f)).count() for f in (tmp_path / "alert_logs" / "data").iterdir() if not f.name.startswith("."))
    assert got() == sorted(want) and table.read().columns == ["alert_id", "log_id"]
    assert written() == 2 * 21 + (5 + 2) + (10 + 5)
    numbers = {a: sum(x == a for x, _ in want) for a, _ in want}
    assert {r.alert_id: r.n_logs for r in table.counts().collect()} == numbers
    table.compact()
    assert got() == sorted(want)
    # Links by themselves, as they were written before there were sets, are read too.
    table.append("old", spark.createDataFrame([("x", "l1"), ("x", "l2")], "alert_id string, log_id string"))
    assert got() == sorted([*want, ("x", "l1"), ("x", "l2")])
    assert {r.alert_id: r.n_logs for r in table.counts().collect()} == {**numbers, "x": 2}


def test_analysis_covers_each_log_once(spark, tmp_path):
    held = Store(spark, str(tmp_path))
    rows = [log(f"l{i}", i % 200, source="ab"[i % 2]) for i in range(430)]

    def scorer(texts):
        return [json.dumps({"summary": f"{len(t.splitlines())} lines", "healthScore": 50}) for t in texts]

    for run, n in (("one", 250), ("two", 430), ("two", 430), ("three", 430)):
        workflows.analysis_run(spark.createDataFrame(rows[:n], LOG_SCHEMA), held, scorer, run, AS_OF)
    covered = held["ledger"].read().collect()
    assert sorted(r.log_id for r in covered) == sorted(r[0] for r in rows)
    assert {r.analysis_id for r in covered} == {r.analysis_id for r in held["analyses"].read().collect()}
    assert {r.analysis_id.split("-")[0] for r in covered} == {"one", "two"}
    assert sum(int(r.summary.split()[0]) for r in held["analyses"].read().collect()) == 430
