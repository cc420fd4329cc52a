"""Line parsers and webhook normalisers, as column expressions.

A parsed line is a struct ``(level, message, ts, metadata, error)``. ``error`` is
null for a good line; callers split the rest off with ``ingest.split_quarantine``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywatch import schemas
from tallywatch.functions.levels import detect_level, normalize_level, severity_to_level
from tallywatch.functions.once import bind, with_fields
from tallywatch.functions.text import or_default
from tallywatch.functions.timing import iso_to_ntz

# The two syslog line forms and the month names of the older one.
RFC3164 = r"(?s)^<(\d{1,3})>([A-Z][a-z]{2})\s+(\d{1,2}) (\d{2}):(\d{2}):(\d{2}) (\S+) ([^:\[\s]+)(?:\[(\d+)\])?: ?(.*)$"
RFC5424 = (
    r"(?s)^<(\d{1,3})>1 (\S+) (\S+) (\S+) (\S+) (\S+) "
    r"(-|(?:\[(?:[^\]\"]++|\"(?:[^\"\\]++|\\.)*+\")*+\])++) ?(.*)$"
)
SD_PARAM = r'([^\s=\[\]"]++)="((?:[^"\\]++|\\.)*+)"'
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

# Keys of a JSON line that become columns; every other key is kept as metadata.
JSON_FIELDS = ["level", "message", "timestamp"]


def _text_map(pairs: dict[str, Column]) -> Column:
    """Map of the given values without the null ones."""
    items: list[Column] = []
    for key, value in pairs.items():
        items += [F.lit(key), value.cast("string")]
    return F.map_filter(F.create_map(*items), lambda _, v: v.isNotNull())


def _parsed(level: Column, message: Column, ts: Column, metadata: Column,
            error: Column | None = None) -> Column:
    return F.struct(
        level.alias("level"),
        message.alias("message"),
        ts.alias("ts"),
        metadata.alias("metadata"),
        (F.lit(None).cast("string") if error is None else error).alias("error"),
    )


def _empty_map() -> Column:
    return F.create_map().cast("map<string,string>")


def parse_json_line(line: Column, arrival: Column) -> Column:
    """JSON object line: level, message and timestamp to columns, the rest to metadata.

    A missing level is guessed from the message, a missing timestamp is the arrival
    time. A line that is no JSON object, has no message, or has a bad timestamp carries an error.
    """
    def build(doc: Column) -> Column:
        message, stamp = doc["message"], doc["timestamp"]
        parsed_ts = iso_to_ntz(stamp)
        error = (
            F.when(doc.isNull(), F.lit("invalid json"))
            .when(message.isNull(), F.lit("no message"))
            .when(stamp.isNotNull() & parsed_ts.isNull(), F.lit("bad timestamp"))
        )
        level = F.coalesce(normalize_level(doc["level"]), detect_level(message))
        rest = F.map_filter(doc, lambda k, _: ~k.isin(JSON_FIELDS))
        return _parsed(level, message, F.coalesce(parsed_ts, arrival), rest, error)

    is_object = F.substring(F.ltrim(line), 1, 1) == "{"
    return bind(F.when(is_object, F.from_json(line, schemas.STR_MAP)), build)


def syslog_year(month: Column, day: Column, clock: list[Column], arrival: Column) -> Column:
    """Timestamp for a line without a year.

    The year of arrival is used, or the year before if the result would lie more
    than one day after arrival (a 31 December line that arrives on 1 January).
    """
    month_no = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), month).cast("int")
    hour, minute, second = [c.cast("int") for c in clock]
    seconds = second.cast("decimal(16,6)")

    def at(year: Column) -> Column:
        return F.try_make_timestamp_ntz(year, month_no, day.cast("int"), hour, minute, seconds)

    latest = arrival + F.expr("INTERVAL 1 DAY")
    return bind(at(F.year(arrival)), lambda now: F.when(now > latest, at(F.year(arrival) - 1)).otherwise(now))


def _fields(line: Column, pattern: str, count: int) -> Column:
    """First ``count`` groups of a full-line match; only the last one may contain a newline.

    One replacement gives all groups at once. A line that does not match stays as it
    was, see ``_matched``.
    """
    marks = "\n".join(f"${i}" for i in range(1, count + 1))
    return F.split(F.regexp_replace(line, pattern, marks), "\n", count)


def _matched(parts: Column) -> Column:
    """Did a line that starts with ``<`` match? Its first group is a number, so the mark is gone."""
    return ~F.startswith(parts[0], F.lit("<"))


def _if_matched(line: Column, parts: Column, build, arrival: Column) -> Column:
    plain = parse_plain(line, arrival)
    return F.when(F.startswith(line, F.lit("<")), bind(
        parts, lambda p: F.when(_matched(p), build(p)).otherwise(plain))).otherwise(plain)


def parse_rfc3164(line: Column, arrival: Column) -> Column:
    """Older syslog form: priority, month-day-time, host, tag and message; else plain text."""
    def build(part: Column) -> Column:
        pri = part[0].cast("int")
        ts = syslog_year(part[1], part[2], [part[3], part[4], part[5]], arrival)
        metadata = _text_map({
            "facility": F.floor(pri / 8).cast("int"),
            "severity": F.pmod(pri, F.lit(8)),
            "hostname": part[6],
            "appName": part[7],
            "procId": F.nullif(part[8], F.lit("")),
        })
        level = severity_to_level(F.pmod(pri, F.lit(8)))
        return _parsed(level, part[9], F.coalesce(ts, arrival), metadata)

    return _if_matched(line, _fields(line, RFC3164, 10), build, arrival)


def _all_fields(line: Column, pattern: str, count: int) -> Column:
    """All groups of a full-line match, each of which may contain anything. One match, unless the line holds the mark itself."""
    mark = "\x1e"
    once = F.split(F.regexp_replace(line, pattern, mark.join(f"${i}" for i in range(1, count + 1))), mark, count)
    singly = F.when(F.rlike(line, F.lit(pattern)), F.array(*(F.regexp_extract(line, pattern, i) for i in range(1, count + 1)))).otherwise(F.array(line))
    return F.when(F.contains(line, F.lit(mark)), singly).otherwise(once)


def parse_rfc5424(line: Column, arrival: Column) -> Column:
    """Newer syslog form: priority, version 1, ISO time, host, app, process, id, data, message."""
    def structured(data: Column) -> Column:
        def pair(text: Column) -> Column:
            key = F.substring_index(text, '="', 1)
            return F.struct(F.concat(F.lit("sd."), key).alias("k"), F.substr(text, F.length(key) + 3, F.length(text) - F.length(key) - 3).alias("v"))

        # A repeated parameter keeps its first value.
        pairs = F.transform(F.regexp_extract_all(data, F.lit(SD_PARAM), 0), pair)
        named = bind(pairs, lambda ps: F.map_from_entries(F.filter(ps, lambda p, i: F.array_position(ps["k"], p["k"]) == i + 1)))
        return F.when(data == "-", _empty_map()).otherwise(named)

    def build(part: Column) -> Column:
        def dashed(i: int) -> Column:
            return F.nullif(part[i], F.lit("-"))

        pri = part[0].cast("int")
        header = _text_map({
            "facility": F.floor(pri / 8).cast("int"),
            "severity": F.pmod(pri, F.lit(8)),
            "hostname": dashed(2),
            "appName": dashed(3),
            "procId": dashed(4),
            "msgId": dashed(5),
        })
        return _parsed(
            severity_to_level(F.pmod(pri, F.lit(8))),
            part[7],
            F.coalesce(iso_to_ntz(dashed(1)), arrival),
            F.map_concat(header, structured(part[6])),
        )

    return _if_matched(line, _all_fields(line, RFC5424, 8), build, arrival)


def parse_plain(line: Column, arrival: Column) -> Column:
    """Free text: kept as the message, level guessed, time of arrival."""
    return _parsed(detect_level(line), line, arrival, _empty_map())


def parse_syslog(line: Column, arrival: Column) -> Column:
    """Either syslog form; a line in neither form is kept as plain text."""
    newer = F.rlike(line, F.lit(r"^<\d{1,3}>1 "))
    return F.when(newer, parse_rfc5424(line, arrival)).otherwise(parse_rfc3164(line, arrival))


def resolve_format(name: Column) -> Column:
    """Known format in lower case; anything else, also null, is plain."""
    lowered = F.lower(name)
    return F.when(lowered.isin(schemas.LOG_FORMATS), lowered).otherwise(F.lit("plain"))


def parse_line(line: Column, log_format: Column, arrival: Column) -> Column:
    """Parse one line by its (resolved) format; custom lines are read as plain text."""
    return (
        F.when(log_format == "json", parse_json_line(line, arrival))
        .when(log_format == "syslog", parse_syslog(line, arrival))
        .otherwise(parse_plain(line, arrival))
    )


# --- webhooks ---------------------------------------------------------------

def normalize_zabbix(payloads: DataFrame) -> DataFrame:
    """Problem notification: severity name to level, subject and message joined."""
    body = F.from_json("payload", schemas.ZABBIX)
    severity = F.col("b.severity")
    # Severity names and their levels.
    level = (
        F.when(severity.isin("Disaster", "High"), "fatal")
        .when(severity == "Average", "error")
        .when(severity == "Warning", "warn")
        .otherwise("info")
    )
    return with_fields(payloads, F.struct(body.alias("b"))).select(
        "payload_id",
        F.lit(0).alias("pos"),
        level.alias("level"),
        F.concat(F.lit("[Zabbix] "), F.coalesce("b.subject", F.lit("")), F.lit(": "), F.coalesce("b.message", F.lit(""))).alias("message"),
        F.col("received_at").alias("ts"),
        _text_map({
            "source": F.lit("zabbix"), "host": F.col("b.host"), "trigger": F.col("b.trigger"),
            "severity": severity, "eventId": F.col("b.eventId"),
        }).alias("metadata"),
    )


def normalize_alertmanager(payloads: DataFrame) -> DataFrame:
    """One row per alert of the payload; firing means error, otherwise info."""
    alerts = with_fields(payloads, F.struct(F.from_json("payload", schemas.ALERTMANAGER).alias("b"))).select(
        "payload_id", "received_at", F.posexplode("b.alerts").alias("pos", "a"))
    labels, notes = F.col("a.labels"), F.col("a.annotations")
    text = F.coalesce(F.nullif(notes["summary"], F.lit("")), notes["description"])
    return alerts.select(
        "payload_id",
        "pos",
        F.when(F.col("a.status") == "firing", "error").otherwise("info").alias("level"),
        F.concat(F.lit("[Prometheus] "), labels["alertname"], F.lit(": "), F.coalesce(text, F.lit(""))).alias("message"),
        F.coalesce(iso_to_ntz(F.col("a.startsAt")), F.col("received_at")).alias("ts"),
        _text_map({
            "source": F.lit("prometheus"), "alertname": labels["alertname"],
            "instance": labels["instance"], "job": labels["job"], "status": F.col("a.status"),
            "labels": F.to_json(labels),
        }).alias("metadata"),
    )


def normalize_datadog(payloads: DataFrame) -> DataFrame:
    """Monitor notification: alert type to level, tags, link and host kept as metadata."""
    body = with_fields(payloads, F.struct(F.from_json("payload", schemas.DATADOG).alias("b")))
    return body.select(
        "payload_id",
        F.lit(0).alias("pos"),
        F.coalesce(normalize_level(F.col("b.level")), F.lit("info")).alias("level"),
        or_default(F.col("b.message"), "[Datadog]").alias("message"),
        F.coalesce(iso_to_ntz(F.col("b.timestamp")), F.col("received_at")).alias("ts"),
        F.map_concat(
            F.map_filter("b.metadata", lambda k, _: k != "source"),
            F.create_map(F.lit("source"), F.lit("datadog")),
        ).alias("metadata"),
    )


def extract_metadata(logs: DataFrame, keys: list[str]) -> DataFrame:
    """Chosen metadata keys as columns named ``meta_<key>``."""
    return logs.select(
        "log_id", *[F.col("metadata")[key].alias(f"meta_{key}") for key in keys])
