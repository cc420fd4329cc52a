import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallywatch.functions.levels import detect_level, normalize_level, severity_to_level
from tallywatch.functions.text import template_of
from tallywatch.sources import ingest, parse

ARRIVAL = dt.datetime(2026, 2, 23, 10, 20)
def parsed(spark, line, arrival=ARRIVAL, kind=parse.parse_syslog):
    df = spark.createDataFrame([(line, arrival)], "line string, at timestamp_ntz")
    return df.select(kind(F.col("line"), F.col("at")).alias("p")).first()["p"]


def test_every_priority_in_both_forms(spark):
    """Facility, severity and level of each of the 192 priorities, expected values from the number itself."""
    levels = {0: "fatal", 1: "fatal", 2: "fatal", 3: "error", 4: "warn", 5: "info", 6: "info", 7: "debug"}
    rows = [(n, form, line, ARRIVAL) for n in range(192) for form, line in (
        ("old", f"<{n}>Jan 12 06:07:{n % 60:02d} unit{n % 5} part{n % 7}[{n}]: number {n}: of <all>"),
        ("new", f"<{n}>1 2026-01-12T06:07:{n % 60:02d}Z unit{n % 5} part{n % 7} {n} - - number {n}: of <all>"))]
    frame = spark.createDataFrame(rows, "n int, form string, line string, at timestamp_ntz")
    found = frame.select("n", "form", parse.parse_syslog(F.col("line"), F.col("at")).alias("p")).collect()
    assert len(found) == 384
    for n, form, p in found:
        assert (p["level"], p["message"]) == (levels[n % 8], f"number {n}: of <all>"), (n, form)
        assert p["ts"] == dt.datetime(2026, 1, 12, 6, 7, n % 60)
        assert p["metadata"] == {"facility": str(n // 8), "severity": str(n % 8), "hostname": f"unit{n % 5}",
                                 "appName": f"part{n % 7}", "procId": str(n)}


def test_syslog_year_goes_back_at_new_year(spark):
    p = parsed(spark, "<13>Dec 31 23:59:58 h app: late", dt.datetime(2026, 1, 1, 0, 0, 1))
    assert p["ts"] == dt.datetime(2025, 12, 31, 23, 59, 58)


def test_syslog_less_than_a_day_ahead_keeps_the_year(spark):
    p = parsed(spark, "<13>Feb 24 10:00:00 h app: ahead")
    assert p["ts"] == dt.datetime(2026, 2, 24, 10)


def test_syslog_single_digit_day_process_id_and_newline(spark):
    p = parsed(spark, "<13>Feb  3 01:02:03 h app[77]: one\ntwo")
    assert p["ts"] == dt.datetime(2026, 2, 3, 1, 2, 3)
    assert p["metadata"]["procId"] == "77" and p["message"] == "one\ntwo"


def test_syslog_bad_date_uses_arrival(spark):
    assert parsed(spark, "<13>Feb 31 01:02:03 h app: x")["ts"] == ARRIVAL


def test_syslog_without_priority_is_plain(spark):
    p = parsed(spark, "Feb 23 10:15:01 host app: disk warning")
    assert (p["level"], p["ts"]) == ("warn", ARRIVAL)


def test_rfc5424(spark):
    p = parsed(spark, r'<165>1 2026-02-23T10:15:03.5+02:00 web app - ID47 [ex@1 a="x \"y\" ]" b="2"][o@2 a="z"] hello: there')
    assert p["ts"] == dt.datetime(2026, 2, 23, 8, 15, 3, 500000)
    assert p["message"] == "hello: there" and p["level"] == "info"
    assert p["metadata"] == {
        "facility": "20", "severity": "5", "hostname": "web", "appName": "app", "msgId": "ID47",
        "sd.a": r'x \"y\" ]', "sd.b": "2"}


def test_rfc5424_with_line_ends_and_marks_inside(spark):
    p = parsed(spark, '<165>1 - web app - - [ex@1 a="x\ny" b="\x1e"] one\ntwo \x1e three')
    assert p["metadata"] == {"facility": "20", "severity": "5", "hostname": "web", "appName": "app", "sd.a": "x\ny", "sd.b": "\x1e"}
    assert p["message"] == "one\ntwo \x1e three"
    assert parsed(spark, "<165>1 no \x1e match")["message"] == "<165>1 no \x1e match"


def test_rfc5424_nil_values(spark):
    p = parsed(spark, "<14>1 - - - - - - just text")
    assert p["metadata"] == {"facility": "1", "severity": "6"}
    assert (p["message"], p["ts"]) == ("just text", ARRIVAL)


@pytest.mark.parametrize("line,level,message,error", [
    ('{"level":"WARNING","message":"m","a":1,"b":{"c":[1,2]}}', "warn", "m", None),
    ('{"message":"fatal error"}', "error", "fatal error", None),
    ('{"level":"odd","message":"all fine"}', "info", "all fine", None),
    ('{"level":"info"}', "info", None, "no message"),
    ('{"message":"m","timestamp":"yesterday"}', "info", "m", "bad timestamp"),
    ('{"message":', None, None, "invalid json"),
    ("[1]", None, None, "invalid json"),
])
def test_json_lines(spark, line, level, message, error):
    p = parsed(spark, line, kind=parse.parse_json_line)
    assert p["error"] == error and p["message"] == message
    if error is None:
        assert p["level"] == level
        if "a" in p["metadata"]:
            assert p["metadata"] == {"a": "1", "b": '{"c":[1,2]}'}


def test_level_words_and_names(spark):
    words = ["An ERROR", "interrupt", "warned", "critical", "debugging", "fatal error", "ok"]
    names = ["trace", "NOTICE", "warn", "Err", "emergency", "nope", " alert "]
    df = spark.createDataFrame(list(zip(words, names)), "w string, n string")
    rows = df.select(detect_level(F.col("w")).alias("d"), normalize_level(F.col("n")).alias("n")).collect()
    assert [r["d"] for r in rows] == ["error", "error", "warn", "fatal", "debug", "error", "info"]
    assert [r["n"] for r in rows] == ["debug", "info", "warn", "error", "fatal", None, "fatal"]


def test_syslog_severities(spark):
    rows = spark.range(8).select(severity_to_level(F.col("id")).alias("l")).collect()
    assert [r["l"] for r in rows] == ["fatal"] * 3 + ["error", "warn", "info", "info", "debug"]


def test_template_masks(spark):
    df = spark.createDataFrame([("id 123e4567-e89b-12d3-a456-426614174000 from 10.0.0.1 took 12ms",)], "m string")
    assert df.select(template_of(F.col("m")).alias("t")).first()["t"] == "id <id> from <ip> took <n>ms"


def test_format_names(spark):
    df = spark.createDataFrame([("JSON",), ("Syslog",), ("xml",), (None,), ("custom",)], "f string")
    rows = df.select(parse.resolve_format(F.col("f")).alias("f")).collect()
    assert [r["f"] for r in rows] == ["json", "syslog", "plain", "plain", "custom"]


def test_read_text_folder(spark, tmp_path):
    (tmp_path / "a.log").write_text('  {"level":"error","message":"x"}\n\n   \n{bad\n')
    parsed_rows = ingest.read_raw_lines(spark, str(tmp_path), "s1", "json", F.lit("2026-01-01").cast("timestamp_ntz"))
    good, bad = ingest.split_quarantine(parsed_rows)
    assert [(r["level"], r["message"]) for r in good.collect()] == [("error", "x")]
    assert [(r["raw_content"], r["error"]) for r in bad.collect()] == [("{bad", "invalid json")]


def test_equal_lines_keep_apart(spark, tmp_path):
    for name in ("a.log", "b.log"):
        (tmp_path / name).write_text("same line\nsame line\n")
    rows = ingest.read_raw_lines(spark, str(tmp_path), "s1", "custom", F.lit("2026-01-01").cast("timestamp_ntz"))
    assert rows.count() == rows.select("log_id").distinct().count() == 4


def test_broken_envelopes_are_kept_aside(spark):
    payloads = ['{"sourceId":"s","logs":[{"level":"info","message":"x"}]}', '{"sourceId":"s","logs":[', '{"sourceId":"s"}', None,
                '{"sourceId":"s","logs":[{"level":"info"}]}']
    rows = spark.createDataFrame([(str(i), p, ARRIVAL) for i, p in enumerate(payloads)], "envelope_id string, payload string, received_at timestamp_ntz")
    bad = {r["log_id"]: r["error"] for r in ingest.broken_batches(rows).collect()}
    assert bad == {"1": ingest.BROKEN_JSON, "2": ingest.NO_ENTRIES, "3": ingest.BROKEN_JSON, "4": ingest.ENTRY_INCOMPLETE}
    assert [r["log_id"] for r in ingest.ingest_batches(rows).collect()] == ["0-0"]
    assert ingest.ingest_single(rows).count() == 0
