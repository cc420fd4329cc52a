"""Frames of the log domain derived from the driver tables.

Every frame is a row-wise projection of one table, so it grows with that table.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywatch.session import configure

LEVEL_CASE = """CASE WHEN event_type = 'error' AND value >= 100 THEN 'fatal'
     WHEN event_type = 'error' THEN 'error' WHEN event_type = 'purchase' THEN 'warn'
     WHEN event_type = 'click' THEN 'debug' ELSE 'info' END"""
ROUTE_CASE = """CASE event_type WHEN 'view' THEN 'http-api' WHEN 'click' THEN 'scheduled-pull'
     ELSE 'syslog-listener' END"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shape_logs(events: DataFrame) -> DataFrame:
    """Log rows from event rows; also used on the event stream."""
    return events.selectExpr(
        "concat('log', lpad(cast(event_id AS string), 12, '0')) AS log_id",
        "concat('src', user_id % 10) AS source_id",
        "concat('srv', user_id % 5) AS server_id",
        f"{LEVEL_CASE} AS level",
        "concat(event_type, ' event for user ', user_id, ' k=', get_json_object(props, '$.k')) AS message",
        "ts",
        "user_id",
        "event_type",
        "value",
    )


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream (a pattern, so one file or a folder both work)."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")


def log_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log rows from the event stream, with the zoned time type watermarks need."""
    return shape_logs(event_stream(spark, sf_dir)).withColumn("ts", F.col("ts").cast("timestamp"))


def log_pieces(spark: SparkSession, sf_dir: str, folder: str, pieces: int) -> Iterator[DataFrame]:
    """The log stream of a folder to which the events are added piece by piece, in the order of their time."""
    events = table(spark, sf_dir, "events")
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    cuts = [first + (last - first) * k / pieces for k in range(pieces)] + [last + dt.timedelta(microseconds=1)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        events.filter((F.col("ts") >= F.lit(a).cast("timestamp_ntz")) & (F.col("ts") < F.lit(b).cast("timestamp_ntz"))).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(events.schema).parquet(folder)
        yield shape_logs(stream).withColumn("ts", F.col("ts").cast("timestamp"))


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape_logs(table(spark, sf_dir, "events"))


def logs_with_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs(spark, sf_dir).selectExpr(
        "*",
        f"""map_filter(map('receivedVia', {ROUTE_CASE},
              'pullMethod', CASE WHEN event_type = 'click' THEN 'ssh-tail' END,
              'senderIp', CASE WHEN event_type IN ('error', 'purchase', 'signup')
                          THEN concat('10.1.0.', user_id % 256) END,
              'service', concat('svc', user_id % 7),
              'duration', cast(round(value) AS bigint) || 'ms'), (k, v) -> v IS NOT NULL) AS metadata""",
    )


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape_raw_lines(logs(spark, sf_dir))


def shape_raw_lines(logs: DataFrame) -> DataFrame:
    """One raw line per log, its form depending on the event type; also used on the stream."""
    return logs.selectExpr(
        "log_id AS line_id",
        "source_id",
        "server_id",
        """CASE event_type
             WHEN 'click' THEN concat('  {"level":"', upper(level), '","message":"', message,
                  '","timestamp":"', date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"),
                  '","user":', user_id, CASE WHEN user_id % 9 = 4 THEN '' ELSE '}' END, ' ')
             WHEN 'error' THEN concat('<', (user_id % 24) * 8 + CASE level WHEN 'fatal' THEN 2 ELSE 3 END, '>',
                  date_format(ts, 'MMM dd HH:mm:ss'), ' ', server_id, ' app: ', message)
             WHEN 'signup' THEN concat('\t', message, ' with warning \n')
             WHEN 'view' THEN CASE WHEN user_id % 13 = 5 THEN '   ' ELSE message END
             ELSE concat('fatal ', message) END AS line""",
        """CASE event_type WHEN 'click' THEN 'JSON' WHEN 'error' THEN 'syslog' WHEN 'signup' THEN 'Custom'
             WHEN 'view' THEN 'plain' ELSE 'csv' END AS format""",
        "ts + INTERVAL 5 SECONDS AS received_at",
    )


def raw_syslog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every log rendered as an older-form syslog message with its sender."""
    return logs(spark, sf_dir).selectExpr(
        "log_id AS message_id",
        """concat('<', (cast(substr(log_id, 4) AS bigint) % 24) * 8 + CASE level WHEN 'fatal' THEN 2
              WHEN 'error' THEN 3 WHEN 'warn' THEN 4 WHEN 'info' THEN 6 ELSE 7 END, '>',
              date_format(ts, 'MMM dd HH:mm:ss'), ' ', server_id, ' ', source_id, ': ', message) AS raw""",
        """concat(CASE WHEN event_type = 'error' THEN '::ffff:' ELSE '' END, '10.1.0.', user_id) AS sender_ip""",
        "CASE WHEN event_type IN ('error', 'view') THEN 'tcp' ELSE 'udp' END AS transport",
        "ts + INTERVAL 5 SECONDS AS received_at",
        "ts AS event_ts",
    )


def raw_syslog_5424(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every log rendered as a newer-form syslog message."""
    return logs(spark, sf_dir).selectExpr(
        "log_id AS message_id",
        """concat('<', (user_id % 24) * 8 + CASE level WHEN 'fatal' THEN 2 WHEN 'error' THEN 3 WHEN 'warn' THEN 4
              WHEN 'info' THEN 6 ELSE 7 END, '>1 ', date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"), ' ', server_id, ' ',
              source_id, ' ', CASE WHEN user_id % 3 = 0 THEN '-' ELSE cast(user_id AS string) END, ' ', event_type, ' ',
              CASE WHEN event_type = 'view' THEN '-' ELSE concat('[meta@1 user="', user_id, '" kind="', event_type, '"]') END,
              ' ', message) AS raw""",
        "ts + INTERVAL 5 SECONDS AS received_at",
    )


def bulk_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One three-entry envelope per order."""
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('env', o_orderkey) AS envelope_id",
        """concat('{"sourceId":"src', o_custkey % 10, '"',
             CASE WHEN o_custkey % 3 = 0 THEN '' ELSE concat(',"serverId":"srv', o_custkey % 5, '"') END,
             ',"format":"json","logs":[{"level":"info","message":"order ', o_orderkey, ' placed","metadata":{"path":"/orders","status":200}},',
             '{"level":"warn","message":"priority ', o_orderpriority, '","timestamp":"', date_format(o_orderdate, 'yyyy-MM-dd'), 'T10:30:00Z"},',
             '{"level":"error","message":"status ', o_orderstatus, '","metadata":{"customer":"c', o_custkey, '"},"timestamp":"',
             date_format(o_orderdate, 'yyyy-MM-dd'), 'T23:30:00-01:00"}]}') AS payload""",
        "o_orderdate AS received_at",
    )


def single_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One one-entry envelope per customer."""
    return table(spark, sf_dir, "customer").selectExpr(
        "concat('one', c_custkey) AS envelope_id",
        """concat('{"sourceId":"src', c_nationkey, '","level":"debug","message":"', c_name, '","metadata":{"segment":"', c_mktsegment, '"}}') AS payload""",
        "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, c_custkey, 0) AS received_at",
    )


def broken_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads per customer that are whole, cut off, without entries, or with an incomplete entry."""
    return table(spark, sf_dir, "customer").selectExpr(
        "concat('bad', c_custkey) AS envelope_id",
        """CASE c_custkey % 5
             WHEN 0 THEN concat('{"sourceId":"src1","level":"info","message":"', c_name, '","logs":[{"level":"info","message":"x"}],"alerts":[{"status":"firing"}]}')
             WHEN 1 THEN concat('{"sourceId":"src1","logs":[{"level":"info","message":"', c_name)
             WHEN 2 THEN concat('{"sourceId":"src', c_nationkey, '","logs":[]}')
             WHEN 3 THEN concat('{"sourceId":"src', c_nationkey, '","level":"info","logs":[{"message":"no level"}],"alerts":[]}')
             END AS payload""",
        "TIMESTAMP_NTZ'2024-01-01 00:00:00' AS received_at",
    )


def http_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetched bodies: the whole web pages, and JSON bodies of several shapes per customer."""
    pages = table(spark, sf_dir, "pages").selectExpr(
        "concat('page', page_id) AS page_id", "'text/html; charset=utf-8' AS content_type", "html AS body")
    json_bodies = table(spark, sf_dir, "customer").selectExpr(
        "concat('json', c_custkey) AS page_id",
        "'application/json' AS content_type",
        """CASE c_custkey % 4
             WHEN 0 THEN concat('["', c_name, '", {"zone":', c_nationkey, ',"seg":"', c_mktsegment, '"}, ', c_custkey, ', null, [1,2]]')
             WHEN 1 THEN concat('{"id":', c_custkey, '}')
             WHEN 2 THEN concat('[{"id": ', c_custkey)
             ELSE '[]' END AS body""",
    )
    return pages.unionByName(json_bodies)


def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole document texts as the chunks of one byte stream per source."""
    return table(spark, sf_dir, "documents").selectExpr(
        "source AS stream_id", "doc_id AS seq", "text AS chunk")


def webhook_payloads(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Three webhook kinds, one payload each per customer."""
    customers = table(spark, sf_dir, "customer")
    received = "TIMESTAMP_NTZ'2024-01-01 00:00:00' AS received_at"
    zabbix = customers.selectExpr(
        "concat('z', c_custkey) AS payload_id",
        """concat('{"host":"h', c_nationkey, '","trigger":"t1","severity":"',
             CASE c_nationkey % 6 WHEN 0 THEN 'Disaster' WHEN 1 THEN 'High' WHEN 2 THEN 'Average' WHEN 3 THEN 'Warning' WHEN 4 THEN 'Information' ELSE 'Not classified' END,
             '","subject":"', c_mktsegment, '","message":"', c_name, '","eventId":"', c_custkey, '"}') AS payload""",
        received,
    )
    alertmanager = customers.selectExpr(
        "concat('p', c_custkey) AS payload_id",
        """concat('{"alerts":[{"status":"firing","startsAt":"2024-01-02T03:04:05Z","labels":{"alertname":"A', c_nationkey,
             '","instance":"i1","job":"j1"},"annotations":{"summary":"', c_mktsegment, '"}},',
             '{"status":"resolved","startsAt":"2024-01-02T05:04:05+02:00","labels":{"alertname":"B', c_custkey,
             '","job":"j2"},"annotations":{"summary":"","description":"', c_name, '"}}]}') AS payload""",
        received,
    )
    datadog = customers.selectExpr(
        "concat('d', c_custkey) AS payload_id",
        """concat('{"level":"', CASE c_custkey % 4 WHEN 0 THEN 'error' WHEN 1 THEN 'warning' WHEN 2 THEN 'info' ELSE 'success' END,
             '","message":"[Datadog] ', c_mktsegment, ': ', c_name, '","timestamp":"2024-01-05T00:00:00Z","metadata":{"source":"dd","host":"h',
             c_nationkey, '","tags":"env:prod"}}') AS payload""",
        received,
    )
    return {"zabbix": zabbix, "alertmanager": alertmanager, "datadog": datadog}


# The ten source types in their usual order, chosen by key.
SOURCE_TYPE = """CASE WHEN s_suppkey % 2 = 0 THEN 'syslog' ELSE element_at(array('zabbix', 'prometheus', 'custom', 'file', 'api',
    'syslog', 'webhook', 'datadog', 'elasticsearch', 'splunk'), cast(s_suppkey % 10 AS int) + 1) END"""


def log_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log source per supplier."""
    return table(spark, sf_dir, "supplier").selectExpr(
        "concat('src', s_suppkey) AS id",
        "concat('org', s_nationkey) AS owner_id",
        "s_name AS name",
        f"{SOURCE_TYPE} AS type",
        "CASE WHEN s_acctbal > 5000 THEN 'online' WHEN s_acctbal > 0 THEN 'offline' ELSE 'unknown' END AS status",
        """CASE WHEN s_suppkey % 2 = 0 THEN
             concat('{"syslogIp":"10.1.0.', s_suppkey, '","syslogIps":["10.1.0.', s_suppkey + 1, '","10.1.1.', s_suppkey, '"]',
                    CASE WHEN s_suppkey % 4 = 0 THEN concat(',"ip":"10.1.0.', s_suppkey + 2, '"') ELSE '' END,
                    ',"serverId":"srv', s_suppkey, '"}')
           ELSE
             concat('{"pullEnabled":', CASE s_suppkey % 7 WHEN 0 THEN 'false' WHEN 1 THEN '"true"' ELSE 'true' END,
                    CASE WHEN s_suppkey % 3 = 0 THEN ',"pullIntervalMs":120000' ELSE '' END,
                    CASE s_suppkey % 5 WHEN 0 THEN ',"pullMethod":"http","httpUrl":"http://h/logs"' WHEN 1 THEN ',"pullMethod":"http"'
                         WHEN 2 THEN ',"pullMethod":"ftp"' ELSE '' END,
                    CASE WHEN s_suppkey % 11 = 0 THEN '' WHEN s_suppkey % 13 = 0 THEN ',"serverId":"gone"'
                         ELSE concat(',"serverId":"srv', s_suppkey, '"') END, '}')
           END AS config""",
        "TIMESTAMP_NTZ'2023-01-01 00:00:00' + make_dt_interval(cast(s_suppkey AS int)) AS created_at",
    )


def remote_servers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One server per supplier."""
    return table(spark, sf_dir, "supplier").selectExpr(
        "concat('srv', s_suppkey) AS id", "s_name AS name", "concat('org', s_nationkey) AS owner_id",
        "CASE WHEN s_suppkey % 5 = 3 THEN 'maintenance' WHEN s_suppkey % 5 = 4 THEN 'inactive' ELSE 'active' END AS status",
    )


CONDITIONS_CASE = """CASE n % 12
  WHEN 0 THEN concat('[{"type":"error_count","params":{"threshold":', n % 20, ',"timeWindowMinutes":', size * 60, '}}]')
  WHEN 1 THEN concat('[{"type":"error_rate","params":{"threshold":', (n % 20) / 40.0D, ',"timeWindowMinutes":', size * 60, '}}]')
  WHEN 2 THEN concat('[{"type":"log_level","params":{"levels":["error","fatal"],"timeWindowMinutes":', size * 60, '}}]')
  WHEN 3 THEN concat('[{"type":"log_level","params":{"levels":"FATAL, warn","timeWindowMinutes":', size * 60, '}}]')
  WHEN 4 THEN concat('[{"type":"keyword_match","params":{"keywords":["K=', size % 10, '","never"],"timeWindowMinutes":', size * 60, '}}]')
  WHEN 5 THEN concat('[{"type":"keyword_match","params":{"keywords":["error event","user ', size % 10, '"],"matchAll":true,"timeWindowMinutes":', size * 60, '}}]')
  WHEN 6 THEN concat('[{"type":"no_logs","params":{"timeWindowMinutes":', size * 6, '}}]')
  WHEN 7 THEN concat('[{"type":"error_count","params":{"threshold":1,"timeWindowMinutes":', size * 60, '}},{"type":"keyword_match","params":{"keywords":["click","purchase"],"timeWindowMinutes":', size * 30, '}}]')
  WHEN 8 THEN concat('[{"type":"keyword_match","params":{"keywords":["view"],"timeWindowMinutes":', size * 60, '}},{"type":"no_logs","params":{}},{"type":"log_level","params":{"levels":["info"],"timeWindowMinutes":', size * 60, '}}]')
  WHEN 9 THEN concat('[{"type":"ai_anomaly","params":{"minConfidence":0.', n % 10, ',"anomalyTypes":["security_concern","error_spike"]}}]')
  WHEN 10 THEN '[{"type":"custom","params":{"expr":"x"}}]'
  ELSE CASE WHEN size % 2 = 0 THEN '[]' ELSE concat('[{"type":"error_count","params":{"threshold":0,"timeWindowMinutes":', size, '}}]') END
  END"""

ACTIONS_CASE = """CASE n % 5
  WHEN 0 THEN '[{"type":"email","config":{"email":"ops@example.com"}},{"type":"slack","config":{"channel":"#ops"}}]'
  WHEN 1 THEN '[{"type":"webhook","config":{"url":"http://hook.example.com/a"}},{"type":"webhook","config":{}}]'
  WHEN 2 THEN '[{"type":"slack","config":{"webhookUrl":"http://chat.example.com/b"}},{"type":"in_app","config":{}}]'
  WHEN 3 THEN '[{"type":"pager","config":{}}]'
  ELSE '[]' END"""


def alert_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rule per supplier, cycling through every condition type; every seventh size is global."""
    return table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS n", "1 + s_suppkey * 7 % 50 AS size", "s_name AS nm").selectExpr(
        "concat('rule', n) AS id",
        "concat(nm, ' ', n) AS name",
        "CASE n % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('watch ', nm) END AS description",
        "concat('user', size % 10) AS owner_id",
        "CASE WHEN size % 7 = 0 THEN NULL ELSE concat('src', size % 12) END AS source_id",
        "CASE WHEN size % 10 = 1 THEN 'disabled' WHEN size % 10 = 2 THEN 'testing' ELSE 'enabled' END AS status",
        "element_at(array('low', 'medium', 'high', 'critical'), cast(n % 4 AS int) + 1) AS severity",
        f"{CONDITIONS_CASE} AS conditions",
        f"{ACTIONS_CASE} AS actions",
        "cast(size AS int) AS cooldown_minutes",
        """CASE WHEN n % 3 = 0 THEN NULL ELSE TIMESTAMP_NTZ'2024-01-30 23:59:00'
             - make_dt_interval(0, 0, cast(n % 120 AS int), 0) END AS last_triggered_at""",
        "n % 5 AS trigger_count",
        "TIMESTAMP_NTZ'2023-06-01 00:00:00' + make_dt_interval(cast(n % 100 AS int)) AS created_at",
    )


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One alert per order."""
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('al', o_orderkey) AS id",
        "concat('rule', o_custkey % 120) AS rule_id",
        "concat('src', o_custkey % 10) AS source_id",
        "array(concat('log', lpad(cast(o_orderkey AS string), 12, '0')), concat('log', lpad(cast(o_custkey AS string), 12, '0'))) AS log_ids",
        "concat('Rule Triggered: ', o_custkey) AS title",
        "concat('total ', cast(o_totalprice AS bigint)) AS description",
        """CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium'
             ELSE 'low' END AS severity""",
        "CASE o_orderstatus WHEN 'F' THEN 'resolved' WHEN 'O' THEN 'active' ELSE 'acknowledged' END AS status",
        "o_orderdate + make_dt_interval(0, 0, cast(o_orderkey % 1440 AS int), 0) AS created_at",
        """CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + make_dt_interval(0, 0, cast(o_orderkey % 1440 + o_custkey % 180 AS int), 0)
             END AS acknowledged_at""",
        """CASE WHEN o_orderstatus = 'F' THEN o_orderdate + make_dt_interval(0, 0, cast(o_orderkey % 1440 + o_custkey % 180 + o_custkey % 600 AS int), 0)
             END AS resolved_at""",
    )


def alert_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One action on an alert per order line."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "concat('al', l_orderkey) AS alert_id",
        "CASE l_returnflag WHEN 'A' THEN 'acknowledge' WHEN 'R' THEN 'resolve' ELSE 'silence' END AS action",
        "concat('user', l_suppkey) AS actor",
        "CASE WHEN l_linestatus = 'F' THEN concat('note ', l_partkey) END AS notes",
        "l_shipdate + make_dt_interval(0, 0, l_linenumber, cast(l_quantity AS int)) AS at",
        "concat_ws('-', lpad(cast(l_linenumber AS string), 3, '0'), lpad(cast(l_partkey AS string), 9, '0'), lpad(cast(l_suppkey AS string), 9, '0'), cast(cast(l_extendedprice AS bigint) AS string)) AS action_id",
    )


def ticket_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One status change of a ticket per order line."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "concat('tkt-al', l_orderkey) AS ticket_id",
        "CASE l_returnflag WHEN 'A' THEN 'IN_PROGRESS' WHEN 'R' THEN 'RESOLVED' ELSE 'CLOSED' END AS status",
        "l_shipdate + make_dt_interval(0, 0, l_linenumber, cast(l_quantity AS int)) AS at",
        "concat_ws('-', lpad(cast(l_linenumber AS string), 3, '0'), lpad(cast(l_partkey AS string), 9, '0'), lpad(cast(l_suppkey AS string), 9, '0'), cast(cast(l_extendedprice AS bigint) AS string)) AS update_id",
    )


def model_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One analysis reply text per order: clean, wrapped in prose, with missing keys, without braces, broken."""
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('an', o_orderkey) AS analysis_id",
        "concat('src', o_custkey % 10) AS source_id",
        "CASE o_orderstatus WHEN 'F' THEN 'batch' WHEN 'O' THEN 'summary' ELSE 'single' END AS analysis_type",
        "concat('provider', o_custkey % 2) AS provider",
        "o_orderdate + make_dt_interval(0, 0, cast(o_orderkey % 1440 AS int), 0) AS created_at",
        "cast(o_custkey * 37 % 40000 AS bigint) AS duration_ms",
        "array(concat('log', lpad(cast(o_orderkey AS string), 12, '0'))) AS log_ids",
        """CASE o_orderkey % 6
             WHEN 0 THEN BODY
             WHEN 1 THEN concat('Here is the result:\n', BODY, '\nHope this helps.')
             WHEN 2 THEN concat('{"severity":"healthy","healthScore":', o_custkey % 101, '}')
             WHEN 3 THEN 'no findings today'
             WHEN 4 THEN concat('{"severity": "warning", "summary": "cut of', o_orderkey)
             ELSE concat('{"anomalies":[],"summary":"order ', o_orderkey, '","healthScore":0,"extra":{"a":1}}') END AS reply"""
        .replace("BODY", """concat('{"anomalies":[{"logId":"log', lpad(cast(o_orderkey AS string), 12, '0'), '","type":"',
              element_at(array('error_spike', 'unusual_pattern', 'security_concern', 'performance_issue'), cast(o_custkey % 4 AS int) + 1),
              '","confidence":0.', o_custkey % 10, ',"description":"', o_orderpriority, '","suggestedAction":"restart"},',
              '{"logId":"log', lpad(cast(o_custkey AS string), 12, '0'), '","type":"unknown","confidence":0.5,"description":"', o_orderstatus, '"}],',
              '"patterns":[{"pattern":"p', o_custkey % 7, '","occurrences":', o_custkey % 50, ',"logIds":["log', lpad(cast(o_orderkey AS string), 12, '0'),
              '","log', lpad(cast(o_custkey AS string), 12, '0'), '"],"significance":"', CASE WHEN o_custkey % 50 > 30 THEN 'high' ELSE 'low' END,
              '","description":"d"}],"severity":"', CASE WHEN o_custkey % 5 = 0 THEN 'critical' ELSE 'warning' END,
              '","summary":"sum ', o_orderkey, '","recommendations":["check ', o_orderpriority, '","rotate"],"healthScore":', o_custkey % 101, '}')"""),
    )


def root_cause_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One root-cause reply per customer."""
    return table(spark, sf_dir, "customer").selectExpr(
        "concat('rca', c_custkey) AS analysis_id",
        "'rca' AS analysis_type",
        """CASE WHEN c_custkey % 5 = 0 THEN '{"confidence":0.9}' WHEN c_custkey % 5 = 1 THEN 'none'
           ELSE concat('{"probableCauses":[{"cause":"', c_mktsegment, '","probability":0.8,"evidence":["e1"],"logIds":[]},{"cause":"other","probability":0.1}],',
             '"affectedComponents":["n', c_nationkey, '","db"],"recommendedFixes":["fix ', c_custkey, '"],"confidence":0.', c_custkey % 10, ',"analysisDepth":"deep"}') END AS reply""",
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of documents and conversations as messages."""
    docs = table(spark, sf_dir, "documents").selectExpr(
        "concat('doc', doc_id) AS log_id", "source AS source_id", "text AS message")
    talk = table(spark, sf_dir, "conversations").selectExpr(
        "concat('conv', conv_id, '-', turn) AS log_id", "role AS source_id", "text AS message")
    return docs.unionByName(talk)
