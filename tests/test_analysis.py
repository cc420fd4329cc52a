import datetime as dt
import random

from pyspark.sql import functions as F

from tallywatch.operators import analysis, logs as store, tenancy

T0 = dt.datetime(2026, 2, 1)
LOG_SCHEMA = "log_id string, source_id string, server_id string, level string, message string, ts timestamp_ntz"


def make_logs(spark, n=600, seed=3):
    rng = random.Random(seed)
    rows = [(f"l{i:04d}", "hot" if rng.random() < 0.6 else rng.choice("abc"), rng.choice(["x", "y"]),
             rng.choice(["info", "warn", "error", "fatal"]), f"job {i} done", T0 + dt.timedelta(seconds=rng.randrange(0, 90_000))) for i in range(n)]
    return rows, spark.createDataFrame(rows, LOG_SCHEMA)


def test_replies(spark):
    texts = {
        "clean": '{"anomalies":[{"logId":"l1","type":"error_spike","confidence":0.9,"description":"d"}],"severity":"warning","summary":"s","healthScore":50}',
        "prose": 'Sure!\n{"summary":"s2","healthScore":0}\nBye', "missing": "{}", "none": "no json here",
        "broken": '{"summary": "x" "y"}', "open": '{"summary": "cut', "wrong": '{"summary": {"a": 1}, "healthScore": 80}',
    }
    replies = spark.createDataFrame(list(texts.items()), "analysis_id string, reply string")
    got = {r["analysis_id"]: r for r in analysis.parse_responses(replies).collect()}
    assert got["clean"]["anomalies"][0]["logId"] == "l1" and got["clean"]["error"] is None
    assert (got["prose"]["summary"], got["prose"]["health_score"]) == ("s2", 0)
    assert (got["missing"]["summary"], got["missing"]["severity"], got["missing"]["health_score"], got["missing"]["patterns"]) == (
        "Analysis completed", "unknown", 100, [])
    assert got["none"]["error"] == got["open"]["error"] == analysis.NO_JSON
    assert got["broken"]["error"] == analysis.BAD_JSON and got["broken"]["severity"] == "unknown"
    assert got["wrong"]["health_score"] == 80


def test_bands(spark):
    df = spark.createDataFrame([(80, 0.7), (79, 0.69), (50, 0.0), (49, 1.0)], "s int, c double")
    rows = df.select(analysis.summary_severity(F.col("s")).alias("s"), analysis.rca_severity(F.col("c")).alias("c")).collect()
    assert [tuple(r) for r in rows] == [("healthy", "critical"), ("warning", "warning"), ("warning", "warning"), ("critical", "critical")]


def test_context_holds_whole_messages(spark):
    rows = [("l1", "s", "x", "error", "m" * 200, T0), ("l2", "s", "x", "info", "n" * 5000, T0 - dt.timedelta(1))]
    logs = spark.createDataFrame(rows, LOG_SCHEMA)
    batch = analysis.analysis_batches(logs)
    text = analysis.render_context(batch).first()["context"].split("\n")
    assert text == ["[ERROR] l1: " + "m" * 200, "[INFO] l2: " + "n" * 5000]
    timed = analysis.render_context(analysis.analysis_batches(logs, 1), with_time=True).orderBy("batch_no").first()
    assert timed["context"].startswith("[2026-02-01 00:00:00] [ERROR] l1: ") and timed["lines"] == 1


def test_batches_and_empty_results(spark):
    rows, logs = make_logs(spark)
    batches = analysis.analysis_batches(logs, 20)
    for source in ("hot", "a"):
        want = [r[0] for r in sorted((r for r in rows if r[1] == source), key=lambda r: (-r[5].timestamp(), r[0]))]
        got = batches.filter(F.col("source_id") == source).orderBy("batch_no", "pos").collect()
        assert [r["log_id"] for r in got] == want
        assert [(r["batch_no"], r["pos"]) for r in got] == [(i // 20, i % 20 + 1) for i in range(len(want))]
    asked = spark.createDataFrame([("1", "hot", "batch"), ("2", "silent", "batch")], "analysis_id string, source_id string, analysis_type string")
    empty = analysis.empty_analyses(asked, batches).collect()
    assert [(r["source_id"], r["provider"], r["severity"], r["log_ids"]) for r in empty] == [("silent", "none", "unknown", [])]


def test_scorer_errors_become_error_results(spark):
    contexts = spark.createDataFrame([("1", "s", "good"), ("2", "s", "bad")], "analysis_id string, source_id string, context string")
    def scorer(texts):
        if "bad" in texts:
            raise RuntimeError("down")
        return ['{"summary":"fine"}'] * len(texts)
    replies = analysis.score_batches(contexts, scorer, parallelism=1)
    assert {r["analysis_id"]: r["scorer_error"] for r in replies.collect()} == {"1": None, "2": "RuntimeError: down"}
    got = {r["analysis_id"]: (r["summary"], r["error"]) for r in analysis.parse_responses(replies).collect()}
    assert got == {"1": ("fine", None), "2": (analysis.NO_JSON, analysis.NO_JSON)}
    single = {r["analysis_id"]: (r["is_anomaly"], r["explanation"]) for r in analysis.parse_single_responses(replies).collect()}
    assert single["2"] == (False, "Analysis failed")


def test_bursts_against_plain_python(spark):
    rows, logs = make_logs(spark)
    want = set()
    for source in {r[1] for r in rows}:
        times = sorted(r[5] for r in rows if r[1] == source)
        run = [times[0]]
        for t in times[1:] + [dt.datetime.max]:
            if t == dt.datetime.max or t >= run[-1] + dt.timedelta(minutes=5):
                if len(run) >= 3:
                    want.add((source, run[0], run[-1], len(run)))
                run = []
            run.append(t)
    got = {(r["source_id"], r["start_ts"], r["end_ts"], r["n"]) for r in analysis.detect_bursts(logs, "5 minutes", 3).collect()}
    assert got == want and want


def test_counts_around_errors_against_plain_python(spark):
    rows, logs = make_logs(spark, 300)
    got = {r["log_id"]: (r["context_rows"], r["context_errors"]) for r in analysis.context_per_error(logs, logs.filter("level = 'fatal'")).collect()}
    margin = dt.timedelta(minutes=5)
    want = {}
    for r in rows:
        if r[3] == "fatal":
            near = [x for x in rows if abs(x[5] - r[5]) <= margin]
            want[r[0]] = (len(near), sum(x[3] in ("error", "fatal") for x in near))
    assert got == want


def test_root_cause_window_and_timeline(spark):
    def at(minutes):
        return T0 + dt.timedelta(minutes=minutes)
    rows = [("l0", "a", "x", "info", "m", at(-5)), ("l1", "a", "x", "error", "m", at(0)), ("l2", "b", "y", "fatal", "m", at(3)),
            ("l3", "a", "x", "error", "m", at(10)), ("l4", "c", "z", "info", "m", at(15)), ("l5", "c", "z", "error", "m", at(16))]
    logs = spark.createDataFrame(rows, LOG_SCHEMA)
    ids = spark.createDataFrame([("l1",), ("l3",), ("absent",)], "log_id string")
    window = analysis.rca_window(logs, ids)
    assert sorted(r["log_id"] for r in window.collect()) == ["l0", "l1", "l2", "l3", "l4"]
    marks = {r["log_id"]: r["significance"] for r in analysis.rca_timeline(window).collect()}
    assert marks == {"l1": "trigger", "l2": "symptom", "l3": "result"}
    parts = {(r["source_id"], r["server_id"]): (r["n"], r["errors"]) for r in analysis.affected_components(window).collect()}
    assert parts == {("a", "x"): (3, 2), ("b", "y"): (1, 1)}
    assert analysis.rca_window(logs, ids.filter("log_id = 'absent'")).count() == 0
    pieces = analysis.rca_context(logs, ids, size=2).orderBy("source_id", "batch_no", "pos").collect()
    assert [(r["log_id"], r["batch_no"]) for r in pieces] == [("l3", 0), ("l1", 0), ("l0", 1), ("l2", 0), ("l4", 0)]


def test_error_spike(spark):
    rows = []
    for hour in range(12):
        for i in range(30 if hour == 10 else 2):
            rows.append((f"h{hour}-{i}", "s", "x", "error" if hour == 10 or i == 0 else "info", "m", T0 + dt.timedelta(hours=hour, minutes=i)))
    found = analysis.detect_error_spikes(spark.createDataFrame(rows, LOG_SCHEMA)).collect()
    assert [(r["bucket_start"], r["errors"], r["mean"], r["deviation"]) for r in found] == [(T0 + dt.timedelta(hours=10), 30, 1.0, 0.0)]


def test_silent_buckets_are_history_without_errors(spark):
    """Against a filled grid: a source that logs in few of its hours."""
    import random
    import statistics

    rng = random.Random(12)
    rows, per_hour = [], {}
    for source, share in (("rare", 0.1), ("busy", 0.9)):
        for hour in range(200):
            if hour == 0 or rng.random() < share:
                errors = rng.choice([0, 1, 2, 3, 12])
                per_hour[source, hour] = errors
                rows += [(f"{source}{hour}-{i}", source, "x", "error" if i < errors else "info", "m", T0 + dt.timedelta(hours=hour, minutes=i)) for i in range(errors + 1)]
    want = set()
    for (source, hour), errors in per_hour.items():
        past = [per_hour.get((source, h), 0) for h in range(max(0, hour - 24), hour)]
        if len(past) >= 2 and errors >= 3 and errors > statistics.mean(past) + 2 * statistics.stdev(past) + 1e-9:
            want.add((source, T0 + dt.timedelta(hours=hour)))
    found = analysis.detect_error_spikes(spark.createDataFrame(rows, LOG_SCHEMA), "1 hour", 24, 2.0).collect()
    assert {(r["source_id"], r["bucket_start"]) for r in found} == want and {s for s, _ in want} == {"rare", "busy"}


def test_search_is_literal_and_case_blind(spark):
    rows = [("1", "s", "x", "info", "CPU at 100% now", T0), ("2", "s", "x", "info", "a_b", T0), ("3", "s", "x", "info", "axb 1000", T0)]
    logs = spark.createDataFrame(rows, LOG_SCHEMA)
    assert [r["log_id"] for r in store.search_logs(logs, "100%").collect()] == ["1"]
    assert [r["log_id"] for r in store.search_logs(logs, "A_B").collect()] == ["2"]


def test_pages_cover_everything_once(spark):
    rows, logs = make_logs(spark, 95)
    seen = [r["log_id"] for page in (1, 2, 3) for r in store.page_logs(logs, page, 40).collect()]
    assert seen == [r[0] for r in sorted(rows, key=lambda r: (-r[5].timestamp(), r[0]))]
    first = store.page_logs(logs, 1, 1, "ASC").first()["log_id"]
    assert first == min(rows, key=lambda r: (r[5], r[0]))[0]
    assert {r["total"] for r in store.page_with_total(logs, 3, 40).collect()} == {95}
    assert "TakeOrderedAndProject" in store.page_logs(logs, 2, 40)._jdf.queryExecution().executedPlan().toString()


def test_ledger(spark):
    _, logs = make_logs(spark, 10)
    ledger = spark.createDataFrame([("l0001", "a0")], "log_id string, analysis_id string")
    new = spark.createDataFrame([("a1", ["l0001", "l0002", "l0002"])], "analysis_id string, log_ids array<string>")
    after = store.mark_analyzed(ledger, new)
    assert after.count() == 3
    flags = {r["log_id"]: r["is_analyzed"] for r in store.with_analyzed_flag(logs, after).collect()}
    assert len(flags) == 10 and [k for k, v in flags.items() if v] == ["l0001", "l0002"]
    assert store.unanalyzed_logs(logs, after).count() == 8


def test_quota_and_retention(spark):
    orgs = spark.createDataFrame([("o1", "free", 4, 1), ("o2", "enterprise", 999, 999)], "organization_id string, plan string, rules long, users long")
    usage = spark.createDataFrame([("o1", "2026-02", 1_500_000_000, 5, 11), ("o2", "2026-02", 10**13, 5, 10**6)],
                                  "organization_id string, period string, bytes_ingested long, logs_ingested long, analyses_run long")
    got = {r["organization_id"]: r for r in tenancy.quota_check(usage, orgs).collect()}
    assert got["o1"]["over_ingestion"] and got["o1"]["over_analyses"] and got["o1"]["over_rules"] and not got["o1"]["over_users"]
    assert got["o1"]["overage_price"] == 0.5
    assert not any(got["o2"][c] for c in ("over_ingestion", "over_analyses", "over_rules", "over_users")) and got["o2"]["overage_price"] == 0
    logs = spark.createDataFrame([("o1", "in", T0 - dt.timedelta(days=1)), ("o1", "out", T0 - dt.timedelta(days=1, seconds=1)),
                                  ("o2", "in2", T0 - dt.timedelta(days=90)), ("o2", "out2", T0 - dt.timedelta(days=91)),
                                  ("unowned", "stray", T0 - dt.timedelta(days=400))],
                                 "organization_id string, log_id string, ts timestamp_ntz")
    assert {r["log_id"] for r in tenancy.apply_retention(logs, orgs, T0).collect()} == {"in", "in2", "stray"}


def test_unregistered_sources_are_metered(spark):
    _, logs = make_logs(spark, 20)
    sources = spark.createDataFrame([("hot", "o1")], "id string, owner_id string")
    none = spark.createDataFrame([], "source_id string, created_at timestamp_ntz")
    got = tenancy.usage_metering(logs, none, sources).collect()
    assert {r["organization_id"] for r in got} == {"o1", tenancy.UNOWNED} and sum(r["logs_ingested"] for r in got) == 20


def test_filters_reach_the_scan(spark, tmp_path):
    from tallywatch.sources.sinks import write_logs

    write_logs(make_logs(spark, 50)[1], str(tmp_path / "logs"))
    found = store.find_logs(spark.read.parquet(str(tmp_path / "logs")), source_id="hot", levels="error,fatal",
                            start=T0, end=T0 + dt.timedelta(hours=6)).select("log_id", "ts")
    spark.conf.set("spark.sql.maxMetadataStringLength", 10000)
    plan = found._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.split("\n") if "FileScan" in line)
    assert "EqualTo(source_id,hot)" in scan and "In(level, [error,fatal])" in scan and "GreaterThanOrEqual(ts" in scan
    assert "PartitionFilters: [isnotnull(dt" in scan and "message" not in scan.split("ReadSchema")[1]


def test_coverage_counts_logs_without_a_join_on_their_ids(spark):
    logs = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), (None,)], "log_id string")
    replies = spark.createDataFrame(
        [("1", ["a", "c", "a"]), ("2", ["c", "gone", None]), ("3", [])], "analysis_id string, log_ids array<string>").selectExpr(
        "*", "'batch' AS analysis_type", "timestamp_ntz'2026-02-01 00:00:00' AS created_at", "1L AS duration_ms", "'{}' AS reply")
    report = analysis.analysis_report(analysis.parse_responses(replies), logs)
    got = report.filter("section = 'coverage'").collect()
    assert [(r["name"], r["n"], r["share"]) for r in got] == [("analysed", 3, 3 / 5)]
    # A join may broadcast all ids named by all analyses through the driver.
    assert "LeftSemi" not in report._jdf.queryExecution().toString()
