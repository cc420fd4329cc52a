import datetime as dt
import json
import random
import re

import pytest

from tallywatch.operators import backtest, rules as engine

AS_OF = dt.datetime(2026, 3, 1, 12)
RULE_SCHEMA = (
    "id string, name string, description string, source_id string, status string, severity string, "
    "conditions string, actions string, cooldown_minutes int, last_triggered_at timestamp_ntz, trigger_count long")
LOG_SCHEMA = "log_id string, source_id string, level string, message string, ts timestamp_ntz"


def rule(rule_id, conditions, source=None, status="enabled", cooldown=5, last=None, description=None):
    text = conditions if isinstance(conditions, str) or conditions is None else json.dumps(conditions)
    return (rule_id, f"name {rule_id}", description, source, status, "high", text, "[]", cooldown, last, 0)


def cond(kind, **params):
    return {"type": kind, "params": params}


def log(log_id, minutes_ago, level="info", source="a", message="m"):
    return (log_id, source, level, message, AS_OF - dt.timedelta(minutes=minutes_ago))


def run(spark, rules, logs, **options):
    frame = engine.evaluate_rules(
        spark.createDataFrame(rules, RULE_SCHEMA), spark.createDataFrame(logs, LOG_SCHEMA), AS_OF, **options)
    return {r["rule_id"]: r for r in frame.collect()}


def matches(row, condition):
    """Ids and verdict of one condition, straight from its meaning."""
    kind, p = condition["type"], condition["params"]
    minutes = p.get("timeWindowMinutes", 10 if kind == "no_logs" else 5)
    since = AS_OF - dt.timedelta(minutes=minutes)
    rows = [l for l in row["logs"] if since <= l[4] <= AS_OF and (row["source"] is None or l[1] == row["source"])]
    bad = [l for l in rows if l[2] in ("error", "fatal")]
    if kind == "error_count":
        return p.get("threshold") is not None and len(bad) >= p["threshold"], bad
    if kind == "error_rate":
        return bool(rows) and p.get("threshold") is not None and len(bad) / len(rows) >= p["threshold"], bad
    if kind == "log_level":
        levels = p["levels"] if isinstance(p["levels"], list) else p["levels"].split(",")
        hit = [l for l in rows if l[2] in [x.strip().lower() for x in levels]]
        return bool(hit), hit
    if kind == "keyword_match":
        found = {k for k in p["keywords"] if any(k.lower() in l[3].lower() for l in rows)}
        hit = [l for l in rows if any(k.lower() in l[3].lower() for k in p["keywords"])]
        return (len(found) == len(p["keywords"]) if p.get("matchAll") else bool(found)), hit
    if kind == "no_logs":
        return not rows, []
    return False, []


def brute(rules, logs):
    out = {}
    for r in rules:
        if r[4] != "enabled":
            continue
        if r[9] is not None and AS_OF < r[9] + dt.timedelta(minutes=r[8]):
            out[r[0]] = (False, [], None, "In cooldown period")
            continue
        ids, first, ok = set(), None, True
        for c in json.loads(r[6]):
            met, hit = matches({"logs": logs, "source": r[3]}, c)
            if not met:
                ok = False
                break
            if hit and first is None:
                first = sorted(hit, key=lambda l: (-l[4].timestamp(), l[0]))[0][0]
            ids |= {l[0] for l in hit}
        out[r[0]] = (ok, sorted(ids), first, "All conditions met" if ok else "Not all conditions met")
    return out


def random_case(seed, n_logs=400, n_rules=40):
    rng = random.Random(seed)
    words = ["timeout", "Connection Refused", "disk", "100%", "a_b", "ok"]
    logs = [(f"l{i:04d}", "hot" if rng.random() < 0.5 else rng.choice(["a", "b", None]), rng.choice(["info", "warn", "error", "fatal", "debug"]),
             " ".join(rng.choice(words) for _ in range(3)), AS_OF - dt.timedelta(seconds=rng.randrange(-300, 7200)))
            for i in range(n_logs)]
    def one():
        w = {} if rng.random() < 0.2 else {"timeWindowMinutes": rng.choice([1, 5, 7, 30, 60, 90])}
        kind = rng.choice(["error_count", "error_rate", "log_level", "keyword_match", "no_logs", "custom", "ai_anomaly"])
        if kind == "error_count":
            return cond(kind, threshold=rng.choice([0, 1, 5, 40]), **w)
        if kind == "error_rate":
            return cond(kind, threshold=rng.choice([0.0, 0.2, 0.4, 0.6]), **w)
        if kind == "log_level":
            return cond(kind, levels=rng.choice([["error"], "FATAL, warn", ["info", "debug"]]), **w)
        if kind == "keyword_match":
            return cond(kind, keywords=rng.choice([[], ["TIMEOUT"], ["disk", "zzz"], ["disk", "Disk"], ["a_b", "%"], ["ok", "ok"]]),
                        matchAll=rng.random() < 0.5, **w)
        return cond(kind, **w)
    rules = [rule(f"r{i:02d}", [one() for _ in range(rng.randrange(0, 4))], rng.choice([None, "hot", "a", "quiet"]),
                  rng.choice(["enabled"] * 5 + ["disabled"]), 5, rng.choice([None, None, AS_OF - dt.timedelta(minutes=3), AS_OF - dt.timedelta(minutes=9)]))
             for i in range(n_rules)]
    return rules, logs


def pairs_of(spark, rules, logs):
    return engine.matched_logs(
        engine.select_rules(spark.createDataFrame(rules, RULE_SCHEMA)), spark.createDataFrame(logs, LOG_SCHEMA), AS_OF).collect()


def check(spark, rules, logs):
    got, want = run(spark, rules, logs), brute(rules, logs)
    assert set(got) == set(want)
    for key, (triggered, ids, first, reason) in want.items():
        r = got[key]
        assert (r["triggered"], r["matched_count"], r["first_log_id"], r["reason"]) == (triggered, len(ids), first, reason), key


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_rules_against_brute_force(spark, seed):
    check(spark, *random_case(seed))


def test_thousands_of_keywords_share_one_index(spark):
    """Five thousand keywords that share common pieces, keywords of any length, and as many windows as rules."""
    rng = random.Random(4)
    words = [f"error code {i:04d} x" for i in range(5000)] + ["", "e", "er", "\U0001F600b", "ERROR", "no such text anywhere", "e c", "(.*)"]
    logs = [log(f"l{i:03d}", rng.randrange(0, 700), rng.choice(["info", "error"]), rng.choice("ab"),
                rng.choice([f"ERROR code {rng.randrange(6000):04d} x", "e", "", "\U0001F600B (.*)", "nothing\nerror CODE 0001 x"])) for i in range(200)]
    logs.append(("null", "a", "info", None, AS_OF))
    keys = [rng.sample(words, 25) for _ in range(200)] + [[w] for w in words[-8:]]
    rules = [rule(f"r{i:03d}", [cond("keyword_match", keywords=k, timeWindowMinutes=1 + i * 3)], rng.choice([None, "a"])) for i, k in enumerate(keys)]
    spelt = [l if l[3] is not None else (*l[:3], "\0", l[4]) for l in logs]
    got, want = run(spark, rules, logs), brute(rules, [l for l in spelt if l[0] != "null"])
    assert {k: (r["triggered"], r["matched_count"], r["first_log_id"]) for k, r in got.items()} == {k: (v[0], len(v[1]), v[2]) for k, v in want.items()}


def plan_of(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_no_join_has_the_scope_alone_for_a_key(spark):
    rules, logs = random_case(7, 60, 10)
    frame, rows = spark.createDataFrame(rules, RULE_SCHEMA), spark.createDataFrame(logs, LOG_SCHEMA)
    parsed = engine.parse_rules(frame)
    cells = engine.cells_of(engine.tag_logs(rows, parsed, engine.rule_profile(parsed), AS_OF))
    probes = engine.probes_of(parsed)
    state = engine.with_matches(engine.judge_rules(parsed, cells, None, AS_OF))
    frames = [engine.answer_probes(probes, cells), engine._matched_counts(engine._selectors(state, "selector"), cells),
              engine.matched_logs(frame, rows, AS_OF)]
    for plan in map(plan_of, frames):
        scoped = [line for line in plan.splitlines() if "Join " in line and re.search("<=> (_s|_scope|scope)#|scope#[0-9]+ <=>", line)]
        assert all("facet#" in line or "_f#" in line for line in scoped)
    assert any("<=>" in plan_of(f) for f in frames)


@pytest.mark.parametrize("rows_per_salt", [1_000_000, 90])
def test_match_table_is_whole(spark, monkeypatch, rows_per_salt):
    monkeypatch.setattr(engine, "ROWS_PER_SALT", rows_per_salt)
    rules, logs = random_case(5)
    pairs = pairs_of(spark, rules, logs)
    want = {(k, i) for k, v in brute(rules, logs).items() for i in v[1]}
    assert len(pairs) == len(want) and {tuple(p) for p in pairs} == want


def test_window_bounds_are_inclusive_and_closed_by_as_of(spark):
    logs = [log("edge", 5, "error"), log("now", 0, "error"), log("old", 5.001, "error"), log("later", -1, "error")]
    rules = [rule("r", [cond("error_count", threshold=2)])]
    assert run(spark, rules, logs)["r"]["triggered"]
    assert sorted(p["log_id"] for p in pairs_of(spark, rules, logs)) == ["edge", "now"]


def test_windows_of_fractions_of_a_minute(spark):
    logs = [log("half", 0.5, "error"), log("late", 0.501, "error"), log("three", 3, "error")]
    rules = [rule("r", [cond("error_count", threshold=1, timeWindowMinutes=0.5)])]
    assert [p["log_id"] for p in pairs_of(spark, rules, logs)] == ["half"]
    assert not run(spark, rules, [log("three", 3, "error")])["r"]["triggered"]


def test_a_null_keyword_stops_no_rule(spark):
    rules = [rule("bad", [cond("keyword_match", keywords=[None])]), rule("part", [cond("keyword_match", keywords=[None, "boom"], matchAll=True)]),
             rule("good", [cond("error_count", threshold=1)])]
    got = run(spark, rules, [log("e", 1, "error", message="boom")])
    assert {k for k, r in got.items() if r["triggered"]} == {"part", "good"}


def test_every_log_of_an_alert_is_linked(spark):
    logs = [log(f"e{i}", 1, "error") for i in range(1200)]
    rules = [rule("r", [cond("error_count", threshold=1)]), rule("quiet", [cond("error_count", threshold=9999)])]
    frame, rows = spark.createDataFrame(rules, RULE_SCHEMA), spark.createDataFrame(logs, LOG_SCHEMA)
    alerts = engine.trigger_alerts(engine.evaluate_rules(frame, rows, AS_OF), AS_OF)
    linked = engine.alert_logs(alerts, engine.matched_logs(frame, rows, AS_OF))
    assert alerts.count() == 1 and linked.count() == linked.select("log_id").distinct().count() == 1200


def test_cooldown_ends_at_its_exact_end(spark):
    rules = [rule("in", [], last=AS_OF - dt.timedelta(minutes=5) + dt.timedelta(microseconds=1)),
             rule("end", [], last=AS_OF - dt.timedelta(minutes=5)),
             rule("default", [], cooldown=None, last=AS_OF - dt.timedelta(minutes=4))]
    got = run(spark, rules, [log("x", 1)])
    assert (got["in"]["triggered"], got["in"]["reason"]) == (False, "In cooldown period")
    assert got["end"]["triggered"] and not got["default"]["triggered"]


def test_empty_conditions_trigger_and_threshold_edges(spark):
    rules = [rule("empty", []), rule("zero", [cond("error_count", threshold=0)]), rule("none", [cond("error_count")]),
             rule("rate_no_rows", [cond("error_rate", threshold=0)], "quiet"), rule("silent", [cond("no_logs")], "quiet"),
             rule("silent_all", [cond("no_logs")]), rule("unreadable", "not json")]
    got = run(spark, rules, [log("x", 7)])
    assert {k for k, v in got.items() if v["triggered"]} >= {"empty", "zero", "silent"}
    assert not got["none"]["triggered"] and not got["rate_no_rows"]["triggered"] and not got["silent_all"]["triggered"]


def test_error_rate_is_exact_past_a_thousand_rows(spark):
    logs = [log(f"e{i}", 1, "error") for i in range(1500)] + [log(f"i{i}", 1) for i in range(1500)]
    got = run(spark, [rule("half", [cond("error_rate", threshold=0.5)]), rule("more", [cond("error_rate", threshold=0.5001)])], logs)
    assert got["half"]["triggered"] and not got["more"]["triggered"]
    assert got["half"]["matched_count"] == 1500


def test_partial_matches_of_an_untriggered_rule_are_kept(spark):
    logs = [log("e", 1, "error", message="boom"), log("i", 2, message="fine")]
    rules = [rule("r", [cond("error_count", threshold=1), cond("keyword_match", keywords=["nope"]), cond("log_level", levels=["info"])])]
    r = run(spark, rules, logs)["r"]
    assert not r["triggered"] and r["matched_count"] == 1 and r["first_log_id"] == "e"


def test_source_selection_keeps_global_rules(spark):
    rules = spark.createDataFrame([rule("own", [], "a"), rule("other", [], "b"), rule("all", []), rule("off", [], "a", "disabled")], RULE_SCHEMA)
    assert {r["id"] for r in engine.select_rules(rules, "a").collect()} == {"own", "all"}
    assert {r["id"] for r in engine.select_rules(rules).collect()} == {"own", "other", "all"}


def test_stored_anomalies_decide_ai_conditions(spark):
    found = spark.createDataFrame([("a", "error_spike", 0.8, AS_OF), ("b", "security_concern", 0.99, AS_OF),
                                   ("a", "security_concern", 0.99, AS_OF + dt.timedelta(minutes=1))],
                                  "source_id string, type string, confidence double, created_at timestamp_ntz")
    ask = [cond("ai_anomaly", minConfidence=0.8, anomalyTypes=["error_spike"])]
    rules = [rule("a", ask, "a"), rule("b", ask, "b"), rule("all", ask),
             rule("late", [cond("ai_anomaly", minConfidence=0.9, anomalyTypes=["security_concern"])], "a")]
    got = run(spark, rules, [log("x", 1)], anomalies=found)
    assert {k for k, v in got.items() if v["triggered"]} == {"a", "all"}
    assert not any(v["triggered"] for v in run(spark, rules, [log("x", 1)]).values())


def test_rule_test_ignores_status_only(spark):
    frame = spark.createDataFrame([rule("off", [], status="testing"), rule("cool", [], status="disabled", last=AS_OF)], RULE_SCHEMA)
    logs = spark.createDataFrame([log("x", 1)], LOG_SCHEMA)
    assert engine.test_rule(frame, logs, AS_OF, "off").first()["triggered"]
    assert not engine.test_rule(frame, logs, AS_OF, "cool").first()["triggered"]


def test_alert_texts(spark):
    rules = [rule("d", [], description="why"), rule("e", [], description=""), rule("n", [])]
    results = engine.evaluate_rules(spark.createDataFrame(rules, RULE_SCHEMA), spark.createDataFrame([log("x", 1)], LOG_SCHEMA), AS_OF)
    rows = {r["rule_id"]: r for r in engine.trigger_alerts(results, AS_OF).collect()}
    assert [rows[k]["description"] for k in "den"] == ["why", "All conditions met", "All conditions met"]
    assert rows["d"]["title"] == "Rule Triggered: name d" and rows["d"]["status"] == "active"
    assert rows["d"]["metadata"].asDict() == {"ruleName": "name d", "triggerReason": "All conditions met", "matchedLogCount": 0}


def test_rule_validation(spark):
    rows = [rule("ok", [cond("no_logs")]), rule("type", [cond("magic")]), rule("json", "nope"), rule("cool", [], cooldown=0),
            rule("status", [], status="paused")]
    got = {r["id"]: r["_error"] for r in engine.validate_rules(spark.createDataFrame(rows, RULE_SCHEMA)).collect()}
    assert got == {"ok": None, "type": "unknown condition type", "json": "conditions unreadable",
                   "cool": "cool-down below one minute", "status": "unknown status"}


def test_status_changes(spark):
    rules = spark.createDataFrame([rule("a", []), rule("b", [])], RULE_SCHEMA)
    changed = engine.set_rule_status(rules, spark.createDataFrame([("a", "disabled")], "id string, status string"))
    assert {r["id"]: r["status"] for r in changed.collect()} == {"a": "disabled", "b": "enabled"}


# --- backtest ----------------------------------------------------------------

def test_cooldown_fold(spark):
    rng, runs, want = random.Random(3), [], set()
    for rule_id, pause in (("a", 1), ("b", 5), ("c", 40)):
        step, free = 0, 0
        for _ in range(150):
            first = step + rng.randrange(1, 9)
            step = first + rng.randrange(0, 30)
            runs.append((rule_id, first, step, pause))
            for k in range(first, step + 1):
                if k >= free:
                    want.add((rule_id, k))
                    free = k + pause
            step += 1
    rng.shuffle(runs)
    kept = backtest.keep_outside_cooldown(spark.createDataFrame(runs, "rule_id string, first long, last long, pause long")).collect()
    assert {(r["rule_id"], r["step"]) for r in kept} == want and len(kept) == len(want)


@pytest.mark.parametrize(("step", "fraction"), [(10, 0), (1, 0), (1, 0.4)])
def test_backtest_against_brute_force(spark, step, fraction):
    rng = random.Random(11)
    start, n = dt.datetime(2026, 3, 1), 400 // step
    end = start + dt.timedelta(minutes=400, seconds=20)
    logs = [(f"l{i:04d}", rng.choice(["a", "a", "a", "b", None]), rng.choice(["info", "error", None]), rng.choice(["disk", "net", None]),
             start + dt.timedelta(seconds=rng.choice([rng.randrange(-4000, 24500), 600 * rng.randrange(-3, 40)]))) for i in range(150)]
    w = lambda minutes: minutes + fraction
    rules = [rule("count", [cond("error_count", threshold=2, timeWindowMinutes=w(25))], "a", cooldown=35),
             rule("zero", [cond("error_count", threshold=0)], "quiet", cooldown=7),
             rule("rate", [cond("error_rate", threshold=0.6, timeWindowMinutes=20)], None, cooldown=20),
             rule("quiet", [cond("no_logs", timeWindowMinutes=10)], "b", cooldown=60),
             rule("silent", [cond("no_logs", timeWindowMinutes=w(3))], None, cooldown=2),
             rule("both", [cond("keyword_match", keywords=["DISK", "net"], matchAll=True, timeWindowMinutes=30), cond("log_level", levels=["info"])], "a", cooldown=1),
             rule("spelt", [cond("keyword_match", keywords=["Disk", "disk"], matchAll=True, timeWindowMinutes=w(2))], None, cooldown=3),
             rule("twice", [cond("keyword_match", keywords=["disk", "disk"], matchAll=True, timeWindowMinutes=30)]),
             rule("long", [cond("error_count", threshold=30, timeWindowMinutes=4000)]),
             rule("found", [cond("ai_anomaly", minConfidence=0.5, anomalyTypes=["error_spike", "other"]), cond("log_level", levels="info")], "a", cooldown=45),
             rule("unfound", [cond("ai_anomaly", minConfidence=0.9, anomalyTypes=["error_spike"])]),
             rule("never", [cond("custom")]), rule("always", [], cooldown=100), rule("off", [], status="disabled")]
    found = [("a", "error_spike", 0.3, start), ("a", "error_spike", 0.8, start + dt.timedelta(minutes=150, seconds=1)),
             ("b", "error_spike", 0.8, start), ("a", "other", 0.9, end + dt.timedelta(days=1))]
    want = set()
    for r in rules:
        last = None
        for k in range(n + 1) if r[4] == "enabled" else ():
            now = start + dt.timedelta(minutes=k * step)
            if last is not None and now < last + dt.timedelta(minutes=r[8]):
                continue
            ok = True
            shifted = [(l[0], l[1], l[2], l[3] or "", l[4] + (AS_OF - now)) for l in logs]
            for c in json.loads(r[6]):
                if c["type"] == "ai_anomaly":
                    p = c["params"]
                    ok = ok and any(a[3] <= now and a[0] == "a" and r[3] in (None, a[0]) and a[1] in p["anomalyTypes"] and a[2] >= p["minConfidence"] for a in found)
                else:
                    ok = ok and matches({"logs": shifted, "source": r[3]}, c)[0]
            if ok:
                want.add((r[0], k))
                last = now
    stored = spark.createDataFrame(found, "source_id string, type string, confidence double, created_at timestamp_ntz")
    got = backtest.backtest_rules(spark.createDataFrame(rules, RULE_SCHEMA), spark.createDataFrame(logs, LOG_SCHEMA), start, end, step, stored).collect()
    assert {(r["rule_id"], r["step"]) for r in got} == want and len(got) == len(want)
    assert all(r["triggered_at"] == start + dt.timedelta(minutes=r["step"] * step) for r in got)
    assert len({r for r, _ in want}) >= 9


def test_pairs_are_dealt_over_tasks_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(engine, "ROWS_PER_SALT", 100)
    monkeypatch.setattr(engine, "RULES_PER_LIST", 10)
    logs = [log(f"e{i}", 1, "error") for i in range(50)]
    rules = [rule(f"r{i:02d}", [cond("error_count", threshold=1)]) for i in range(30)]
    pairs = engine.matched_logs(spark.createDataFrame(rules, RULE_SCHEMA), spark.createDataFrame(logs, LOG_SCHEMA), AS_OF)
    # 1,500 pairs of few rows in one scope and facet.
    assert len(re.findall(r"RepartitionByExpression \[.*\], 16", plan_of(pairs))) == 2
    got = [tuple(p) for p in pairs.collect()]
    assert len(got) == 1500 and set(got) == {(r[0], l[0]) for r in rules for l in logs}


def test_rules_of_one_selector_are_listed_together(spark, monkeypatch):
    monkeypatch.setattr(engine, "RULES_PER_LIST", 10)
    state = spark.createDataFrame([(f"r{i}", "s") for i in range(25)] + [("x", "t"), ("x", "t")], "rule_id string, selector string")
    lists = engine._rule_lists(state).collect()
    assert 2 <= len([r for r in lists if r["selector"] == "s"]) <= 3
    assert sorted(v for r in lists for v in r["rule_ids"]) == sorted([f"r{i}" for i in range(25)] + ["x", "x"])


def test_backtest_moves_questions_and_not_rules(spark):
    logs = [log(f"e{i}", 60 - i, "error") for i in range(60)]
    conds = {k: [cond("error_count", threshold=k, timeWindowMinutes=10)] for k in (1, 5, 99)}
    rules = [rule(f"r{k}{x}", conds[k], cooldown=5) for k in conds for x in "ab"] + [rule("slow", conds[1], cooldown=20)]
    start = AS_OF - dt.timedelta(minutes=60)
    found = backtest.backtest_rules(spark.createDataFrame(rules, RULE_SCHEMA), spark.createDataFrame(logs, LOG_SCHEMA), start, AS_OF)
    # Counts along the steps are kept per question, which all rules here share.
    assert not re.search(r"windowspecdefinition\(rule_id#\d+, pos#", plan_of(found))
    steps = {}
    for r in found.collect():
        steps.setdefault(r["rule_id"], []).append(r["step"])
    want = {"r1": range(0, 61, 5), "r5": range(4, 61, 5)}
    assert {k: sorted(v) for k, v in steps.items()} == {
        **{f"{k}{x}": list(v) for k, v in want.items() for x in "ab"}, "slow": list(range(0, 61, 20))}
