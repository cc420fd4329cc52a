"""DuckDB SQL with the same result as the registered query of the same name.

Written from the meaning of each operator over the driver tables, without the
intermediate text forms (JSON, syslog lines, envelopes) that the Spark side parses.
"""

from __future__ import annotations

import re

# Common table expressions; each may use the ones above it.
CTE = {
    "logs": """
SELECT 'log' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS log_id, event_id,
  'src' || (user_id % 10) AS source_id, 'srv' || (user_id % 5) AS server_id,
  CASE WHEN event_type = 'error' AND value >= 100 THEN 'fatal' WHEN event_type = 'error' THEN 'error'
       WHEN event_type = 'purchase' THEN 'warn' WHEN event_type = 'click' THEN 'debug' ELSE 'info' END AS level,
  event_type || ' event for user ' || user_id || ' k=' || json_extract_string(props, '$.k') AS message,
  ts, user_id, event_type, value,
  CASE event_type WHEN 'view' THEN 'http-api' WHEN 'click' THEN 'scheduled-pull' ELSE 'syslog-listener' END AS route
FROM events""",
    "clock": "SELECT max(ts) AS now FROM events",
    "messages": """
SELECT 'doc' || doc_id AS log_id, source AS source_id, text AS message FROM documents
UNION ALL SELECT 'conv' || conv_id || '-' || turn, role, text FROM conversations""",
    "leveled": """
SELECT log_id, source_id, message, CASE WHEN contains(lower(message), 'err') THEN 'error'
  WHEN contains(lower(message), 'warn') THEN 'warn'
  WHEN contains(lower(message), 'fatal') OR contains(lower(message), 'critical') THEN 'fatal'
  WHEN contains(lower(message), 'debug') THEN 'debug' ELSE 'info' END AS level
FROM messages""",
    "parsed_lines": """
SELECT log_id, source_id, event_type, user_id, ts AS event_ts,
  event_type = 'click' AND user_id % 9 = 4 AS bad,
  CASE event_type WHEN 'click' THEN 'debug' WHEN 'error' THEN level WHEN 'signup' THEN 'warn'
    WHEN 'view' THEN 'info' ELSE 'fatal' END AS level,
  CASE event_type WHEN 'signup' THEN message || ' with warning' WHEN 'purchase' THEN 'fatal ' || message ELSE message END AS message,
  CASE event_type
    WHEN 'click' THEN '{"level":"DEBUG","message":"' || message || '","timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ')
      || '","user":' || user_id || CASE WHEN user_id % 9 = 4 THEN '' ELSE '}' END
    WHEN 'error' THEN '<' || ((user_id % 24) * 8 + CASE level WHEN 'fatal' THEN 2 ELSE 3 END) || '>'
      || strftime(ts, '%b %d %H:%M:%S') || ' ' || server_id || ' app: ' || message
    WHEN 'signup' THEN message || ' with warning' WHEN 'view' THEN message ELSE 'fatal ' || message END AS raw_content,
  CASE event_type WHEN 'click' THEN 'json' WHEN 'error' THEN 'syslog' WHEN 'signup' THEN 'custom' ELSE 'plain' END AS format,
  CASE event_type WHEN 'click' THEN 'user=' || user_id
    WHEN 'error' THEN 'appName=app;facility=' || (user_id % 24) || ';hostname=' || server_id || ';severity='
      || CASE level WHEN 'fatal' THEN 2 ELSE 3 END
    ELSE '' END AS metadata,
  CASE WHEN event_type IN ('click', 'error') THEN date_trunc('second', ts) ELSE ts + INTERVAL 5 SECOND END AS ts
FROM logs WHERE NOT (event_type = 'view' AND user_id % 13 = 5)""",
    "sources": """
SELECT s_suppkey AS n, 'src' || s_suppkey AS id, 'org' || s_nationkey AS owner_id,
  CASE WHEN s_acctbal > 5000 THEN 'online' WHEN s_acctbal > 0 THEN 'offline' ELSE 'unknown' END AS status,
  CASE WHEN s_suppkey % 2 = 0 THEN 'srv' || s_suppkey WHEN s_suppkey % 11 = 0 THEN NULL
       WHEN s_suppkey % 13 = 0 THEN 'gone' ELSE 'srv' || s_suppkey END AS server_id
FROM supplier""",
    "sender_ips": """
SELECT DISTINCT n, unnest(list_concat(['10.1.0.' || n, '10.1.0.' || (n + 1), '10.1.1.' || n],
  CASE WHEN n % 4 = 0 THEN ['10.1.0.' || (n + 2)] ELSE [] END)) AS ip
FROM sources WHERE n % 2 = 0""",
    "senders": "SELECT ip, 'src' || max(n) AS source_id, 'srv' || max(n) AS server_id FROM sender_ips GROUP BY ip",
    "pulls": """
SELECT n, id AS source_id,
  CASE WHEN n % 5 IN (0, 1) THEN 'http' WHEN n % 5 = 2 THEN 'ftp' ELSE 'ssh-tail' END AS method,
  CAST(CASE WHEN n % 3 = 0 THEN 120000 ELSE 60000 END AS BIGINT) AS interval_ms,
  CASE WHEN n % 5 IN (3, 4) THEN '/var/log/syslog' WHEN n % 5 = 0 THEN 'http://h/logs' END AS target,
  CASE WHEN n % 5 IN (3, 4) THEN
         CASE WHEN server_id IS NULL THEN 'no server id' WHEN server_id = 'gone' THEN 'server not found'
              WHEN n % 5 = 3 THEN 'server is maintenance' ELSE 'server is inactive' END
       WHEN n % 5 = 1 THEN 'no url' WHEN n % 5 = 2 THEN 'unknown method' END AS skip_reason
FROM sources WHERE n % 2 = 1 AND n % 7 NOT IN (0, 1)""",
    "plan": "SELECT source_id, method, interval_ms, target, CASE WHEN skip_reason IS NULL THEN 'due' ELSE 'skipped' END AS status, skip_reason FROM pulls",
    "base": "SELECT s_suppkey AS n, 1 + s_suppkey * 7 % 50 AS size, s_name AS nm FROM supplier",
    "rules": """
SELECT n, size, 'rule' || n AS id, nm || ' ' || n AS name,
  CASE n % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'watch ' || nm END AS description,
  'user' || (size % 10) AS owner_id,
  CASE WHEN size % 7 = 0 THEN NULL ELSE 'src' || (size % 12) END AS source_id,
  CASE WHEN size % 10 = 1 THEN 'disabled' WHEN size % 10 = 2 THEN 'testing' ELSE 'enabled' END AS status,
  ['low', 'medium', 'high', 'critical'][n % 4 + 1] AS severity,
  CAST(size AS INTEGER) AS cooldown_minutes,
  CASE WHEN n % 3 = 0 THEN NULL ELSE TIMESTAMP '2024-01-30 23:59:00' - to_minutes(n % 120) END AS last_triggered_at,
  n % 5 AS trigger_count,
  TIMESTAMP '2023-06-01 00:00:00' + to_days(CAST(n % 100 AS INTEGER)) AS created_at
FROM base""",
    "cooling": "SELECT r.*, coalesce(now < last_triggered_at + to_minutes(cooldown_minutes), false) AS suppressed FROM rules r, clock",
    "conds": """
SELECT id AS rule_id, source_id, c.* FROM rules, LATERAL (
  SELECT unnest(CASE n % 12
    WHEN 0 THEN [{'pos': 0, 'type': 'error_count', 'threshold': n % 20 + 0.0, 'w': size * 60, 'levels': ['error', 'fatal'], 'keywords': NULL::VARCHAR[], 'every': false}]
    WHEN 1 THEN [{'pos': 0, 'type': 'error_rate', 'threshold': (n % 20) / 40.0, 'w': size * 60, 'levels': ['error', 'fatal'], 'keywords': NULL, 'every': false}]
    WHEN 2 THEN [{'pos': 0, 'type': 'log_level', 'threshold': NULL, 'w': size * 60, 'levels': ['error', 'fatal'], 'keywords': NULL, 'every': false}]
    WHEN 3 THEN [{'pos': 0, 'type': 'log_level', 'threshold': NULL, 'w': size * 60, 'levels': ['fatal', 'warn'], 'keywords': NULL, 'every': false}]
    WHEN 4 THEN [{'pos': 0, 'type': 'keyword_match', 'threshold': NULL, 'w': size * 60, 'levels': NULL, 'keywords': ['K=' || (size % 10), 'never'], 'every': false}]
    WHEN 5 THEN [{'pos': 0, 'type': 'keyword_match', 'threshold': NULL, 'w': size * 60, 'levels': NULL, 'keywords': ['error event', 'user ' || (size % 10)], 'every': true}]
    WHEN 6 THEN [{'pos': 0, 'type': 'no_logs', 'threshold': NULL, 'w': size * 6, 'levels': NULL, 'keywords': NULL, 'every': false}]
    WHEN 7 THEN [{'pos': 0, 'type': 'error_count', 'threshold': 1.0, 'w': size * 60, 'levels': ['error', 'fatal'], 'keywords': NULL, 'every': false},
                 {'pos': 1, 'type': 'keyword_match', 'threshold': NULL, 'w': size * 30, 'levels': NULL, 'keywords': ['click', 'purchase'], 'every': false}]
    WHEN 8 THEN [{'pos': 0, 'type': 'keyword_match', 'threshold': NULL, 'w': size * 60, 'levels': NULL, 'keywords': ['view'], 'every': false},
                 {'pos': 1, 'type': 'no_logs', 'threshold': NULL, 'w': 10, 'levels': NULL, 'keywords': NULL, 'every': false},
                 {'pos': 2, 'type': 'log_level', 'threshold': NULL, 'w': size * 60, 'levels': ['info'], 'keywords': NULL, 'every': false}]
    WHEN 9 THEN [{'pos': 0, 'type': 'ai_anomaly', 'threshold': (n % 10) / 10.0, 'w': 5, 'levels': NULL, 'keywords': NULL, 'every': false}]
    WHEN 10 THEN [{'pos': 0, 'type': 'custom', 'threshold': NULL, 'w': 5, 'levels': NULL, 'keywords': NULL, 'every': false}]
    ELSE CASE WHEN size % 2 = 0 THEN [] ELSE [{'pos': 0, 'type': 'error_count', 'threshold': 0.0, 'w': size, 'levels': ['error', 'fatal'], 'keywords': NULL, 'every': false}] END
  END, recursive := true)) c""",
    "seen": """
SELECT c.rule_id, c.pos, l.log_id, l.ts, l.level, l.message, c.type,
  CASE WHEN c.levels IS NOT NULL THEN CAST(list_contains(c.levels, l.level) AS INTEGER)
       WHEN c.keywords IS NOT NULL THEN len(list_filter(c.keywords, lambda k: contains(lower(l.message), lower(k)))) ELSE 0 END AS hit
FROM conds c JOIN logs l ON (c.source_id IS NULL OR c.source_id = l.source_id), clock
WHERE l.ts >= now - to_minutes(c.w) AND l.ts <= now""",
    "words": """
SELECT rule_id, pos, count(*) AS n FROM (
  SELECT DISTINCT c.rule_id, c.pos, k FROM (SELECT rule_id, pos, unnest(keywords) AS k FROM conds) c
  JOIN seen s ON s.rule_id = c.rule_id AND s.pos = c.pos AND contains(lower(s.message), lower(c.k))) GROUP BY ALL""",
    "replies": """
SELECT o_orderkey, o_custkey, 'an' || o_orderkey AS analysis_id, 'src' || (o_custkey % 10) AS source_id, o_orderkey % 6 AS form,
  CASE o_orderstatus WHEN 'F' THEN 'batch' WHEN 'O' THEN 'summary' ELSE 'single' END AS analysis_type,
  o_orderdate + to_minutes(o_orderkey % 1440) AS created_at, o_orderpriority, o_orderstatus,
  o_custkey * 37 % 40000 AS duration_ms, 'log' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS log_id,
  'log' || lpad(CAST(o_custkey AS VARCHAR), 12, '0') AS other_id
FROM orders""",
    "analyses": """
SELECT *, CASE WHEN form IN (0, 1) THEN CASE WHEN o_custkey % 5 = 0 THEN 'critical' ELSE 'warning' END
    WHEN form = 2 THEN 'healthy' ELSE 'unknown' END AS severity,
  CASE form WHEN 2 THEN 'Analysis completed' WHEN 3 THEN 'Analysis failed: No valid JSON found in response'
    WHEN 4 THEN 'Analysis failed: No valid JSON found in response' WHEN 5 THEN 'order ' || o_orderkey
    ELSE 'sum ' || o_orderkey END AS summary,
  CAST(CASE WHEN form IN (0, 1, 2) THEN o_custkey % 101 WHEN form = 5 THEN 0 ELSE 100 END AS INTEGER) AS health_score
FROM replies""",
    "anomalies": """
SELECT analysis_id, source_id, created_at, 0 AS pos, log_id,
  ['error_spike', 'unusual_pattern', 'security_concern', 'performance_issue'][o_custkey % 4 + 1] AS type,
  (o_custkey % 10) / 10.0 AS confidence, o_orderpriority AS description, 'restart' AS suggested_action
FROM replies WHERE form IN (0, 1)
UNION ALL SELECT analysis_id, source_id, created_at, 1, other_id, 'unknown', 0.5, o_orderstatus, NULL FROM replies WHERE form IN (0, 1)""",
    # Every minute from the first log on, and what each condition counts at it: sums up to it less sums before its window.
    "ticks": """
SELECT step, t0 + to_microseconds(step * 60000000) AS t FROM (
  SELECT min(ts) AS t0, unnest(generate_series(0, (epoch_us(max(ts)) - epoch_us(min(ts))) // 60000000)) AS step FROM events)""",
    "live_conds": "SELECT c.* FROM conds c JOIN rules r ON r.id = c.rule_id WHERE r.status = 'enabled'",
    "cond_sums": """
SELECT rule_id, pos, ts, sum(n) OVER o AS n, sum(hit) OVER o AS hit, sum(k1) OVER o AS k1, sum(k2) OVER o AS k2 FROM (
  SELECT c.rule_id, c.pos, l.ts, count(*) AS n, count(*) FILTER (list_contains(c.levels, l.level)) AS hit,
    count(*) FILTER (contains(lower(l.message), lower(c.keywords[1]))) AS k1, count(*) FILTER (contains(lower(l.message), lower(c.keywords[2]))) AS k2
  FROM live_conds c JOIN logs l ON (c.source_id IS NULL OR l.source_id = c.source_id) GROUP BY ALL)
WINDOW o AS (PARTITION BY rule_id, pos ORDER BY ts)""",
    "cond_ticks": """
SELECT g.rule_id, g.pos, g.step, coalesce(a.n, 0) - coalesce(b.n, 0) AS total, coalesce(a.hit, 0) - coalesce(b.hit, 0) AS hits,
  CAST(coalesce(a.k1, 0) > coalesce(b.k1, 0) AS INTEGER) + CAST(coalesce(a.k2, 0) > coalesce(b.k2, 0) AS INTEGER) AS words
FROM (SELECT c.rule_id, c.pos, t.step, t.t, t.t - to_minutes(c.w) AS since FROM live_conds c, ticks t) g
ASOF LEFT JOIN cond_sums a ON a.rule_id = g.rule_id AND a.pos = g.pos AND a.ts <= g.t
ASOF LEFT JOIN cond_sums b ON b.rule_id = g.rule_id AND b.pos = g.pos AND b.ts < g.since""",
    "cond_onsets": """
SELECT c.rule_id, c.pos, min(a.created_at) AS onset FROM live_conds c JOIN anomalies a ON (c.source_id IS NULL OR a.source_id = c.source_id)
WHERE c.type = 'ai_anomaly' AND a.type IN ('security_concern', 'error_spike') AND a.confidence >= c.threshold GROUP BY ALL""",
    "cond_met": """
SELECT x.rule_id, x.step, coalesce(CASE c.type WHEN 'error_count' THEN x.hits >= c.threshold
    WHEN 'error_rate' THEN x.total > 0 AND x.hits / x.total >= c.threshold WHEN 'log_level' THEN x.hits > 0
    WHEN 'keyword_match' THEN CASE WHEN c.every THEN x.words = len(c.keywords) ELSE x.words > 0 END
    WHEN 'no_logs' THEN x.total = 0 WHEN 'ai_anomaly' THEN o.onset <= t.t END, false) AS met
FROM cond_ticks x JOIN live_conds c USING (rule_id, pos) JOIN ticks t USING (step) LEFT JOIN cond_onsets o USING (rule_id, pos)""",
    "met_ticks": """
SELECT rule_id, step FROM cond_met GROUP BY ALL HAVING bool_and(met)
UNION ALL SELECT r.id, t.step FROM rules r, ticks t WHERE r.status = 'enabled' AND NOT EXISTS (SELECT 1 FROM conds c WHERE c.rule_id = r.id)""",
    "met_runs": """
SELECT rule_id, first, last, CAST(greatest(1, r.cooldown_minutes) AS BIGINT) AS pause, row_number() OVER (PARTITION BY rule_id ORDER BY first) AS i FROM (
  SELECT rule_id, min(step) AS first, max(step) AS last FROM (
    SELECT *, step - row_number() OVER (PARTITION BY rule_id ORDER BY step) AS island FROM met_ticks) GROUP BY rule_id, island)
JOIN rules r ON r.id = rule_id""",
    "anomaly_met": """
SELECT DISTINCT c.rule_id, c.pos FROM conds c JOIN anomalies a ON (c.source_id IS NULL OR a.source_id = c.source_id)
WHERE c.type = 'ai_anomaly' AND a.type IN ('security_concern', 'error_spike') AND a.confidence >= c.threshold""",
    "results": """
SELECT c.rule_id, c.pos, c.type, c.levels, c.keywords, CAST(coalesce(s.hits, 0) AS BIGINT) AS hits,
  CAST(CASE WHEN c.type IN ('error_rate', 'no_logs') THEN coalesce(s.total, 0) ELSE 0 END AS BIGINT) AS total,
  CAST(coalesce(w.n, 0) AS INTEGER) AS keywords_matched,
  coalesce(CASE c.type WHEN 'error_count' THEN coalesce(s.hits, 0) >= c.threshold
    WHEN 'error_rate' THEN coalesce(s.total, 0) > 0 AND s.hits / s.total >= c.threshold
    WHEN 'log_level' THEN coalesce(s.hits, 0) > 0
    WHEN 'keyword_match' THEN CASE WHEN c.every THEN coalesce(w.n, 0) = len(c.keywords) ELSE coalesce(w.n, 0) > 0 END
    WHEN 'no_logs' THEN coalesce(s.total, 0) = 0 ELSE false END, false) AS met
FROM conds c LEFT JOIN (SELECT rule_id, pos, sum(hit) AS hits, count(*) AS total FROM seen GROUP BY ALL) s
  ON s.rule_id = c.rule_id AND s.pos = c.pos
LEFT JOIN words w ON w.rule_id = c.rule_id AND w.pos = c.pos""",
    "verdicts": """
SELECT r.id AS rule_id, r.suppressed, min(x.pos) FILTER (NOT x.met) AS first_miss
FROM cooling r LEFT JOIN results x ON x.rule_id = r.id GROUP BY ALL""",
    "matches": """
SELECT s.rule_id, s.log_id, min(s.pos) AS pos, any_value(s.ts) AS ts
FROM seen s JOIN verdicts v ON v.rule_id = s.rule_id
WHERE s.hit > 0 AND NOT v.suppressed AND (v.first_miss IS NULL OR s.pos < v.first_miss) GROUP BY s.rule_id, s.log_id""",
    "firsts": "SELECT rule_id, log_id AS first_log_id FROM matches QUALIFY row_number() OVER (PARTITION BY rule_id ORDER BY pos, ts DESC, log_id) = 1",
    "counted": "SELECT rule_id, count(*) AS n FROM matches GROUP BY ALL",
    "evaluated": """
SELECT r.id AS rule_id, r.name AS rule_name, r.source_id, r.severity, r.description, r.status,
  NOT r.suppressed AND v.first_miss IS NULL AS triggered, coalesce(m.n, 0) AS matched_count, f.first_log_id,
  CASE WHEN r.suppressed THEN 'In cooldown period' WHEN v.first_miss IS NULL THEN 'All conditions met'
    ELSE 'Not all conditions met' END AS reason
FROM cooling r JOIN verdicts v ON v.rule_id = r.id LEFT JOIN counted m ON m.rule_id = r.id LEFT JOIN firsts f ON f.rule_id = r.id""",
    "alerts": """
SELECT o_orderkey, o_custkey, 'al' || o_orderkey AS id, 'rule' || (o_custkey % 120) AS rule_id, 'src' || (o_custkey % 10) AS source_id,
  'log' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS log_a, 'log' || lpad(CAST(o_custkey AS VARCHAR), 12, '0') AS log_b,
  'Rule Triggered: ' || o_custkey AS title, 'total ' || CAST(trunc(o_totalprice) AS BIGINT) AS description,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' ELSE 'low' END AS severity,
  CASE o_orderstatus WHEN 'F' THEN 'resolved' WHEN 'O' THEN 'active' ELSE 'acknowledged' END AS status,
  o_orderdate + to_minutes(o_orderkey % 1440) AS created_at,
  CASE WHEN o_orderstatus <> 'O' THEN o_custkey % 180 END AS ack_minutes,
  CASE WHEN o_orderstatus = 'F' THEN o_custkey % 180 + o_custkey % 600 END AS resolve_minutes
FROM orders""",
    "acts": """
SELECT 'al' || l_orderkey AS alert_id, CASE l_returnflag WHEN 'A' THEN 'acknowledge' WHEN 'R' THEN 'resolve' ELSE 'silence' END AS action,
  'user' || l_suppkey AS actor, CASE WHEN l_linestatus = 'F' THEN 'note ' || l_partkey END AS notes,
  l_shipdate + to_minutes(l_linenumber) + to_seconds(CAST(l_quantity AS INTEGER)) AS moment,
  lpad(CAST(l_linenumber AS VARCHAR), 3, '0') || '-' || lpad(CAST(l_partkey AS VARCHAR), 9, '0') || '-' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0')
    || '-' || CAST(trunc(l_extendedprice) AS BIGINT) AS action_id,
  CASE l_returnflag WHEN 'A' THEN 'IN_PROGRESS' WHEN 'R' THEN 'RESOLVED' ELSE 'CLOSED' END AS ticket_status
FROM lineitem""",
    "tickets": """
SELECT 'tkt-' || a.id AS id, a.id AS alert_id, 'Alert: ' || coalesce(r.name, 'Anomaly Detected') AS title, a.description,
  CASE a.severity WHEN 'critical' THEN 'CRITICAL' WHEN 'high' THEN 'HIGH' WHEN 'medium' THEN 'MEDIUM' ELSE 'LOW' END AS priority,
  'OPEN' AS status, a.log_a AS log_id, r.source_id, s.server_id, a.rule_id, a.created_at, r.n
FROM alerts a LEFT JOIN rules r ON r.id = a.rule_id LEFT JOIN sources s ON s.id = r.source_id""",
    "routed": """
SELECT id AS ticket_id, rule_id, c.pos, c.channel, c.config, priority AS severity, status FROM tickets, LATERAL (
  SELECT unnest(CASE n % 5
    WHEN 0 THEN [{'pos': 0, 'channel': 'email', 'config': 'email=ops@example.com'}, {'pos': 1, 'channel': 'slack', 'config': 'channel=#ops'}]
    WHEN 1 THEN [{'pos': 0, 'channel': 'webhook', 'config': 'url=http://hook.example.com/a'}, {'pos': 1, 'channel': 'webhook', 'config': ''}]
    WHEN 2 THEN [{'pos': 0, 'channel': 'slack', 'config': 'webhookUrl=http://chat.example.com/b'}, {'pos': 1, 'channel': 'in_app', 'config': ''}]
    WHEN 3 THEN [{'pos': 0, 'channel': 'pager', 'config': ''}] ELSE [] END, recursive := true)) c WHERE n IS NOT NULL""",
    "outcomes": """
SELECT ticket_id, rule_id, pos, channel, NOT (channel = 'pager' OR (channel IN ('slack', 'webhook') AND config NOT LIKE '%http%')) AS success,
  CASE WHEN channel = 'email' THEN 'Email notification logged (SMTP not configured)' WHEN channel = 'in_app' THEN 'In-app notification created'
    WHEN config LIKE 'url=%' THEN 'Webhook delivered to ' || config[5:] WHEN config LIKE 'webhookUrl=%' THEN 'Slack notification sent' END AS message,
  CASE WHEN channel = 'webhook' AND config = '' THEN 'Webhook URL not configured'
    WHEN channel = 'slack' AND config NOT LIKE 'webhookUrl=%' THEN 'Slack webhook URL not configured'
    WHEN channel = 'pager' THEN 'Unknown notification type' END AS error
FROM routed""",
    "fatals": "SELECT log_id, ts FROM logs WHERE level = 'fatal'",
    "envelope": "SELECT min(ts) - INTERVAL 5 MINUTE AS lo, max(ts) + INTERVAL 5 MINUTE AS hi FROM fatals",
    "around": "SELECT l.* FROM logs l, envelope WHERE ts >= lo AND ts <= hi",
    "tenant_logs": "SELECT l.*, coalesce(s.owner_id, 'unowned') AS organization_id FROM logs l LEFT JOIN sources s ON s.id = l.source_id",
    "orgs": """
SELECT owner_id AS organization_id, count(*) AS rules, count(*) FILTER (status = 'online') AS users,
  CASE WHEN count(*) > 5 THEN 'pro' WHEN count(*) > 3 THEN 'starter' ELSE 'free' END AS plan FROM sources GROUP BY ALL""",
    "usage": """
SELECT coalesce(l.organization_id, a.organization_id) AS organization_id, coalesce(l.period, a.period) AS period,
  CAST(coalesce(bytes, 0) AS BIGINT) AS bytes_ingested, CAST(coalesce(l.n, 0) AS BIGINT) AS logs_ingested,
  CAST(coalesce(a.n, 0) AS BIGINT) AS analyses_run
FROM (SELECT organization_id, strftime(ts, '%Y-%m') AS period, sum(strlen(message)) AS bytes, count(*) AS n FROM tenant_logs GROUP BY ALL) l
FULL JOIN (SELECT s.owner_id AS organization_id, strftime(r.created_at, '%Y-%m') AS period, count(*) AS n
           FROM replies r JOIN sources s ON s.id = r.source_id GROUP BY ALL) a
  ON a.organization_id = l.organization_id AND a.period = l.period""",
    "text_lines": """
SELECT log_id || '#' || (i - 1) AS log_id, parts[i] AS message FROM (
  SELECT log_id, parts, unnest(generate_series(1, len(parts))) AS i FROM (SELECT log_id, string_split(message, chr(10)) AS parts FROM messages))""",
    "templates": r"""
SELECT log_id, regexp_replace(regexp_replace(regexp_replace(message,
  '[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}', '<id>', 'g'), '[0-9]+(\.[0-9]+){3}', '<ip>', 'g'), '[0-9]+', '<n>', 'g') AS template
FROM (SELECT log_id, message FROM logs UNION ALL SELECT log_id, message FROM text_lines)""",
}


def _names(sql: str) -> set[str]:
    """Common table expressions a text refers to."""
    return {name for name in CTE if re.search(rf"(FROM|JOIN|,)\s+{name}\b", sql)}


def _with(body: str) -> str:
    """Put the common table expressions a body needs in front of it."""
    order = list(CTE)
    needed: set[str] = set()
    todo = list(_names(body))
    while todo:
        name = todo.pop()
        if name not in needed:
            needed.add(name)
            todo += _names(CTE[name])
    if not needed:
        return body.strip()
    parts = ", ".join(f"{name} AS ({CTE[name].strip()})" for name in order if name in needed)
    if body.lstrip().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {parts}, " + body.lstrip()[len("WITH RECURSIVE"):].strip()
    return f"WITH {parts} {body.strip()}"


def _type_sql(kind: str) -> str:
    met = "met"
    join = ""
    if kind == "ai_anomaly":
        met, join = "a.rule_id IS NOT NULL AS met", "LEFT JOIN anomaly_met a ON a.rule_id = x.rule_id AND a.pos = x.pos"
    return f"SELECT x.rule_id, x.pos, x.hits, x.total, x.keywords_matched, {met} FROM results x {join} WHERE x.type = '{kind}'"


_PARSED = """
SELECT log_id, source_id, level, message, {raw}format, metadata, ts FROM parsed_lines WHERE NOT bad"""

_SEV = "CASE level WHEN 'fatal' THEN 2 WHEN 'error' THEN 3 WHEN 'warn' THEN 4 WHEN 'info' THEN 6 ELSE 7 END"

# Runs of minutes at which a rule is met, walked one by one with its cool-down.
_KEPT = """
WITH RECURSIVE walk AS (
  SELECT rule_id, i, pause, first AS start, (last - first) // pause + 1 AS n, first + pause * ((last - first) // pause + 1) AS free FROM met_runs WHERE i = 1
  UNION ALL SELECT r.rule_id, r.i, r.pause, greatest(r.first, w.free), CASE WHEN greatest(r.first, w.free) > r.last THEN 0 ELSE (r.last - greatest(r.first, w.free)) // r.pause + 1 END,
    CASE WHEN greatest(r.first, w.free) > r.last THEN w.free ELSE greatest(r.first, w.free) + r.pause * ((r.last - greatest(r.first, w.free)) // r.pause + 1) END
  FROM walk w JOIN met_runs r ON r.rule_id = w.rule_id AND r.i = w.i + 1),
kept AS (SELECT rule_id, unnest(generate_series(start, start + pause * (n - 1), pause)) AS step FROM walk WHERE n > 0)"""

# Last minute the streams can judge: ten minutes late at most, and the minute itself closed.
_HORIZON = "(SELECT (epoch_us(max(ts)) // 1000 * 1000 - 660000000 - epoch_us(min(ts))) // 60000000 FROM events)"
_NO_AI = "rule_id NOT IN (SELECT rule_id FROM conds WHERE type = 'ai_anomaly')"

BODIES = {
    "ingest_batches": """
SELECT 'env' || o_orderkey || '-' || i AS log_id, 'src' || (o_custkey % 10) AS source_id,
  CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE 'srv' || (o_custkey % 5) END AS server_id,
  ['info', 'warn', 'error'][i + 1] AS level,
  CASE i WHEN 0 THEN 'order ' || o_orderkey || ' placed' WHEN 1 THEN 'priority ' || o_orderpriority ELSE 'status ' || o_orderstatus END AS message,
  'json' AS format,
  CASE i WHEN 0 THEN 'path=/orders;status=200' WHEN 2 THEN 'customer=c' || o_custkey END AS metadata,
  CASE i WHEN 0 THEN o_orderdate WHEN 1 THEN o_orderdate + INTERVAL 630 MINUTE ELSE o_orderdate + INTERVAL 1470 MINUTE END AS ts,
  false AS is_analyzed
FROM orders, (SELECT unnest([0, 1, 2]) AS i)
UNION ALL
SELECT 'one' || c_custkey || '-0', 'src' || c_nationkey, NULL, 'debug', c_name, NULL, 'segment=' || c_mktsegment,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(c_custkey), false FROM customer""",
    "parse_dispatch": _PARSED.format(raw="raw_content, "),
    "stream_ingest": _PARSED.format(raw=""),
    "quarantine": """
SELECT log_id, source_id, format, raw_content, 'invalid json' AS error, 'line' AS route FROM parsed_lines WHERE bad
UNION ALL SELECT 'bad' || c_custkey, CASE WHEN k IN (2, 3) AND route <> 'alertmanager' THEN 'src' || c_nationkey END,
  'json', CASE k WHEN 1 THEN '{"sourceId":"src1","logs":[{"level":"info","message":"' || c_name
    WHEN 2 THEN '{"sourceId":"src' || c_nationkey || '","logs":[]}'
    WHEN 3 THEN '{"sourceId":"src' || c_nationkey || '","level":"info","logs":[{"message":"no level"}],"alerts":[]}' END,
  CASE WHEN k IN (1, 4) THEN 'invalid json' WHEN route = 'single' OR (route = 'bulk' AND k = 3) THEN 'source, level or message missing' ELSE 'no entries' END, route
FROM (SELECT *, c_custkey % 5 AS k, unnest(['bulk', 'single', 'alertmanager']) AS route FROM customer) WHERE k > 0""",
    "read_raw_lines": "SELECT 'files' AS source_id, level, message, date_trunc('second', ts) AS ts, event_id % 2 = 0 AS known FROM logs",
    "incremental_pull": "SELECT 'files' AS source_id, level, message, date_trunc('second', ts) AS ts, CAST(event_id % 3 AS INTEGER) AS pull FROM logs",
    "explode_pages": """
SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, parts[i] AS line FROM (
  SELECT page_id, parts, unnest(generate_series(1, len(parts))) AS i FROM (
    SELECT 'page' || page_id AS page_id, string_split(html, chr(10)) AS parts FROM pages
    UNION ALL
    SELECT 'json' || c_custkey, CASE c_custkey % 4
      WHEN 0 THEN [c_name, '{"zone":' || c_nationkey || ',"seg":"' || c_mktsegment || '"}', CAST(c_custkey AS VARCHAR), 'null', '[1,2]']
      WHEN 1 THEN ['{"id":' || c_custkey || '}'] WHEN 2 THEN ['[{"id": ' || c_custkey] ELSE [] END FROM customer))""",
    "sender_source_map": "SELECT ip, source_id, server_id FROM senders",
    "syslog_ingest": f"""
SELECT l.log_id, coalesce(s.source_id, 'unregistered:10.1.0.' || l.user_id) AS source_id, s.server_id, l.level, l.message,
  'appName=' || l.source_id || ';facility=' || (l.event_id % 24) || ';hostname=' || l.server_id
  || ';receivedVia=syslog-listener;senderIp=10.1.0.' || l.user_id || ';severity=' || {_SEV.replace('level', 'l.level')} AS metadata,
  date_trunc('second', l.ts) AS ts
FROM logs l LEFT JOIN senders s ON s.ip = '10.1.0.' || l.user_id""",
    "frame_lines": r"""
SELECT stream_id, CAST(i - 1 AS BIGINT) AS line_no, trim(parts[i], chars) AS line FROM (
  SELECT stream_id, parts, unnest(generate_series(1, len(parts) - 1)) AS i FROM (
    SELECT source AS stream_id, string_split(string_agg(text, '' ORDER BY doc_id), chr(10)) AS parts FROM documents GROUP BY source)),
  (SELECT ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(65279) AS chars)
WHERE length(trim(parts[i], chars)) > 0""",
    "provenance_counts": """
SELECT route AS received_via, CASE WHEN event_type = 'click' THEN 'ssh-tail' END AS pull_method, count(*) AS n,
  count(*) FILTER (event_type IN ('error', 'purchase', 'signup')) AS with_sender FROM logs GROUP BY 1, 2""",
    "pull_plan": "SELECT * FROM plan",
    "ingestion_status": """
SELECT 'route' AS kind, route AS name, count(*) AS n, max(ts) AS last_ts FROM logs GROUP BY route
UNION ALL SELECT 'senders', 'mapped', count(*), NULL FROM senders
UNION ALL SELECT 'pull', status, count(*), NULL FROM plan GROUP BY status""",
    "parse_json_lines": """
SELECT log_id, level, message, CASE WHEN value > 50 THEN date_trunc('second', ts) ELSE ts END AS ts,
  'kind=' || event_type || ';user=' || user_id AS metadata, CAST(NULL AS VARCHAR) AS error FROM logs""",
    "parse_syslog3164": f"""
SELECT log_id, level, message, date_trunc('second', ts) AS ts, 'appName=' || source_id || ';facility=' || (event_id % 24)
  || ';hostname=' || server_id || ';severity=' || {_SEV} AS metadata, CAST(NULL AS VARCHAR) AS error FROM logs""",
    "parse_syslog5424": f"""
SELECT log_id, level, message, date_trunc('second', ts) AS ts, 'appName=' || source_id || ';facility=' || (user_id % 24)
  || ';hostname=' || server_id || ';msgId=' || event_type || CASE WHEN user_id % 3 = 0 THEN '' ELSE ';procId=' || user_id END
  || CASE WHEN event_type = 'view' THEN '' ELSE ';sd.kind=' || event_type || ';sd.user=' || user_id END
  || ';severity=' || {_SEV} AS metadata, CAST(NULL AS VARCHAR) AS error FROM logs""",
    "normalize_level": """
SELECT c_custkey, raw, CASE WHEN upper(trim(raw)) IN ('DEBUG', 'TRACE', 'VERBOSE') THEN 'debug' WHEN upper(trim(raw)) IN ('INFO', 'NOTICE') THEN 'info'
  WHEN upper(trim(raw)) IN ('WARNING', 'WARN') THEN 'warn' WHEN upper(trim(raw)) IN ('ERROR', 'ERR') THEN 'error'
  WHEN upper(trim(raw)) IN ('FATAL', 'CRITICAL', 'EMERGENCY', 'ALERT') THEN 'fatal' END AS level
FROM (SELECT c_custkey, ['DEBUG', 'Trace', 'verbose', 'INFO', 'notice', 'WARNING', 'warn', 'ERROR', 'Err', 'FATAL', 'critical',
  'EMERGENCY', 'alert', 'success', ' info '][c_custkey % 15 + 1] AS raw FROM customer)""",
    "detect_level": "SELECT log_id, level FROM leveled",
    "normalize_webhooks": """
SELECT 'z' || c_custkey AS payload_id, 0 AS pos,
  CASE WHEN c_nationkey % 6 IN (0, 1) THEN 'fatal' WHEN c_nationkey % 6 = 2 THEN 'error' WHEN c_nationkey % 6 = 3 THEN 'warn' ELSE 'info' END AS level,
  '[Zabbix] ' || c_mktsegment || ': ' || c_name AS message, TIMESTAMP '2024-01-01 00:00:00' AS ts,
  'eventId=' || c_custkey || ';host=h' || c_nationkey || ';severity='
    || ['Disaster', 'High', 'Average', 'Warning', 'Information', 'Not classified'][c_nationkey % 6 + 1] || ';source=zabbix;trigger=t1' AS metadata
FROM customer
UNION ALL SELECT 'p' || c_custkey, 0, 'error', '[Prometheus] A' || c_nationkey || ': ' || c_mktsegment, TIMESTAMP '2024-01-02 03:04:05',
  'alertname=A' || c_nationkey || ';instance=i1;job=j1;labels={"alertname":"A' || c_nationkey || '","instance":"i1","job":"j1"};source=prometheus;status=firing' FROM customer
UNION ALL SELECT 'p' || c_custkey, 1, 'info', '[Prometheus] B' || c_custkey || ': ' || c_name, TIMESTAMP '2024-01-02 03:04:05',
  'alertname=B' || c_custkey || ';job=j2;labels={"alertname":"B' || c_custkey || '","job":"j2"};source=prometheus;status=resolved' FROM customer
UNION ALL SELECT 'd' || c_custkey, 0, CASE c_custkey % 4 WHEN 0 THEN 'error' WHEN 1 THEN 'warn' ELSE 'info' END,
  '[Datadog] ' || c_mktsegment || ': ' || c_name, TIMESTAMP '2024-01-05 00:00:00', 'host=h' || c_nationkey || ';source=datadog;tags=env:prod' FROM customer""",
    "metadata_extract": """
SELECT log_id, route AS "meta_receivedVia", 'svc' || (user_id % 7) AS meta_service, CAST(round(value) AS BIGINT) || 'ms' AS meta_duration,
  CAST(NULL AS VARCHAR) AS meta_status FROM logs""",
    "find_logs": """
SELECT log_id, source_id, level, message, ts FROM logs WHERE source_id = 'src3' AND level IN ('error', 'fatal')
  AND contains(lower(message), 'k=1') AND ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-25 00:00:00'""",
    "page_logs": "SELECT log_id, source_id, level, message, ts, (SELECT count(*) FROM logs) AS total FROM logs ORDER BY ts DESC, log_id LIMIT 50 OFFSET 100",
    "search_logs": "SELECT log_id, source_id, CAST(length(message) AS INTEGER) AS n_chars FROM messages WHERE contains(lower(message), 'the')",
    "log_stats": """
SELECT CASE WHEN grouping(source_id) = 1 AND grouping(level) = 1 THEN 'total' WHEN grouping(source_id) = 1 THEN 'level' ELSE 'source' END AS kind,
  coalesce(level, source_id) AS name, count(*) AS n, count(*) FILTER (level IN ('error', 'fatal')) AS errors
FROM logs GROUP BY GROUPING SETS ((level), (source_id), ())""",
    "lookup_logs": """
SELECT a.id AS request_id, a.pos, l.log_id, l.level FROM (
  SELECT id, 0 AS pos, log_a AS log_id FROM alerts UNION ALL SELECT id, 1, log_b FROM alerts) a JOIN logs l ON l.log_id = a.log_id""",
    "unanalyzed_logs": """
SELECT l.log_id, l.source_id, l.level, l.message, l.ts FROM logs l
WHERE NOT EXISTS (SELECT 1 FROM replies r WHERE r.log_id = l.log_id AND r.analysis_type = 'batch') ORDER BY ts DESC, log_id LIMIT 100""",
    "mark_analyzed": """
SELECT l.source_id, r.log_id IS NOT NULL AS is_analyzed, count(*) AS n FROM logs l
LEFT JOIN (SELECT DISTINCT log_id FROM replies WHERE analysis_type IN ('batch', 'summary')) r ON r.log_id = l.log_id GROUP BY 1, 2""",
    "level_distribution": """
SELECT source_id, string_agg(level || '=' || n, ';' ORDER BY level) AS levels
FROM (SELECT source_id, level, count(*) AS n FROM logs GROUP BY ALL) GROUP BY source_id""",
    "time_range": """
SELECT level, min(ts) AS start_ts, max(ts) AS end_ts FROM logs GROUP BY level
UNION ALL SELECT 'none', now, now FROM clock""",
    "volume_timeseries": """
SELECT time_bucket(INTERVAL 6 HOUR, ts) AS bucket_start, source_id, count(*) AS n, count(*) FILTER (level IN ('error', 'fatal')) AS errors,
  count(*) FILTER (level IN ('error', 'fatal')) / count(*) AS error_rate FROM logs GROUP BY 1, 2""",
    "rule_selection": "SELECT id, source_id, severity FROM rules WHERE status = 'enabled' AND (source_id = 'src3' OR source_id IS NULL)",
    "rule_cooldown": "SELECT id AS rule_id, cooldown_minutes, suppressed FROM cooling",
    "rule_error_count": _type_sql("error_count"),
    "rule_error_rate": _type_sql("error_rate"),
    "rule_log_level": _type_sql("log_level"),
    "rule_keyword_match": _type_sql("keyword_match"),
    "rule_no_logs": _type_sql("no_logs"),
    "rule_ai_anomaly": _type_sql("ai_anomaly"),
    "rule_unknown_type": _type_sql("custom"),
    "evaluate_rules": "SELECT rule_id, rule_name, triggered, matched_count, first_log_id, reason FROM evaluated WHERE status = 'enabled'",
    "rule_test": "SELECT rule_id, rule_name, triggered, matched_count, first_log_id, reason FROM evaluated",
    "alert_logs": """
SELECT m.rule_id, m.log_id FROM matches m JOIN evaluated e ON e.rule_id = m.rule_id WHERE e.status = 'enabled' AND e.triggered""",
    "rule_matched_logs": "SELECT m.rule_id, m.log_id FROM matches m JOIN rules r ON r.id = m.rule_id WHERE r.status = 'enabled'",
    "trigger_alerts": """
SELECT 'rule' AS origin, rule_id, source_id, 'Rule Triggered: ' || rule_name AS title, coalesce(nullif(description, ''), reason) AS description,
  severity, 'active' AS status, rule_name, reason, matched_count FROM evaluated WHERE status = 'enabled' AND triggered
UNION ALL SELECT 'manual', NULL, 'src' || c_nationkey, 'Manual ' || c_name, c_mktsegment, CASE WHEN c_acctbal < 0 THEN 'high' ELSE 'low' END,
  'active', NULL, NULL, NULL FROM customer""",
    "rule_stats": """
SELECT r.id AS rule_id, greatest(r.last_triggered_at, a.last) AS last_triggered_at, r.trigger_count + coalesce(a.n, 0) AS trigger_count
FROM rules r LEFT JOIN (SELECT rule_id, max(created_at) AS last, count(*) AS n FROM alerts GROUP BY rule_id) a ON a.rule_id = r.id""",
    "backtest_rules": _KEPT + """
SELECT rule_id, step, t AS triggered_at FROM kept JOIN ticks USING (step)""",
    "rule_listing": "SELECT id, name, owner_id, status, created_at FROM rules",
    "find_alerts": "SELECT id, source_id, title, created_at FROM alerts WHERE status = 'active' AND severity = 'high' ORDER BY created_at DESC, id LIMIT 50",
    "alert_stats": """
SELECT 'total' AS kind, CAST(NULL AS VARCHAR) AS name, count(*) AS n FROM alerts
UNION ALL SELECT 'recent', NULL, count(*) FROM alerts WHERE status = 'active' AND created_at >= (SELECT max(created_at) FROM alerts) - INTERVAL 1 HOUR
UNION ALL SELECT 'severity', severity, count(*) FROM alerts GROUP BY severity
UNION ALL SELECT 'status', s, count(a.id) FROM (SELECT unnest(['active', 'acknowledged', 'resolved', 'silenced']) AS s) LEFT JOIN alerts a ON a.status = s GROUP BY s""",
    "alert_lifecycle": """
SELECT a.id, a.severity, a.source_id, a.created_at, CASE f.last WHEN 'acknowledge' THEN 'acknowledged' WHEN 'resolve' THEN 'resolved'
    WHEN 'silence' THEN 'silenced' ELSE a.status END AS status,
  CASE WHEN f.ack IS NOT NULL THEN f.ack.actor WHEN a.ack_minutes IS NULL THEN f.res.actor END AS acknowledged_by,
  CASE WHEN f.ack IS NOT NULL THEN f.ack.moment WHEN a.ack_minutes IS NULL THEN f.res.moment
    ELSE a.created_at + to_minutes(a.ack_minutes) END AS acknowledged_at,
  coalesce(f.resolved_at, a.created_at + to_minutes(a.resolve_minutes)) AS resolved_at, f.notes AS resolution_notes,
  coalesce(f.n, 0) AS n_actions
FROM alerts a LEFT JOIN (
  SELECT alert_id, arg_max(action, (moment, action_id)) AS last, arg_max({'actor': actor, 'moment': moment}, (moment, action_id)) FILTER (action = 'acknowledge') AS ack,
    arg_min({'actor': actor, 'moment': moment}, (moment, action_id)) FILTER (action = 'resolve') AS res, max(moment) FILTER (action = 'resolve') AS resolved_at,
    arg_max(notes, (moment, action_id)) FILTER (action <> 'silence' AND notes IS NOT NULL) AS notes, count(*) AS n FROM acts GROUP BY alert_id) f ON f.alert_id = a.id""",
    "tickets_from_alerts": """
SELECT id, title, description, priority, status, log_id, source_id, server_id, rule_id FROM tickets
UNION ALL SELECT 'tkt-now-' || e.rule_id, 'Alert: ' || rule_name, coalesce(nullif(e.description, ''), reason), upper(e.severity), 'OPEN', first_log_id,
  e.source_id, s.server_id, e.rule_id FROM evaluated e LEFT JOIN sources s ON s.id = e.source_id WHERE e.status = 'enabled' AND triggered""",
    "ticket_board": """
SELECT coalesce(u.status, t.status) AS status, t.priority, count(*) AS n, min(t.created_at) AS oldest, max(t.created_at) AS newest
FROM tickets t LEFT JOIN (SELECT alert_id, arg_max(ticket_status, (moment, action_id)) AS status FROM acts GROUP BY alert_id) u ON u.alert_id = t.alert_id GROUP BY 1, 2""",
    "route_notifications": "SELECT ticket_id, rule_id, pos, channel, severity, status, config FROM routed",
    "notification_outcomes": "SELECT * FROM outcomes",
    "render_notifications": """
SELECT t.id AS ticket_id, r.pos, r.channel,
  CASE r.channel
    WHEN 'webhook' THEN '{"alert":{"id":"' || t.id || '","title":"' || t.title || '","description":"' || t.description || '","severity":"' || t.priority
      || '","status":"OPEN"' || coalesce(',"sourceId":"' || t.source_id || '"', '') || ',"createdAt":"' || strftime(t.created_at, '%Y-%m-%dT%H:%M:%S.%gZ')
      || '"},"timestamp":"2024-02-01T00:00:00.000Z"}'
    WHEN 'slack' THEN '{' || CASE WHEN r.config LIKE 'channel=%' THEN '"channel":"#ops",' ELSE '' END || '"attachments":[{"color":"' || c.color
      || '","title":"' || chr(128680) || ' ' || t.title || '","text":"' || t.description || '","fields":[{"title":"Severity","value":"' || t.priority
      || '","short":true},{"title":"Status","value":"OPEN","short":true},{"title":"Source","value":"' || coalesce(t.source_id, 'N/A')
      || '","short":true},{"title":"Alert ID","value":"' || t.id || '","short":true}],"footer":"tallywatch","ts":"' || CAST(epoch(t.created_at) AS BIGINT) || '"}]}'
    WHEN 'email' THEN t.description END AS body,
  CASE WHEN r.channel = 'email' THEN '[' || t.priority || '] ' || t.title END AS subject,
  CASE WHEN r.channel = 'slack' THEN c.color END AS color
FROM routed r JOIN tickets t ON t.id = r.ticket_id
JOIN (SELECT unnest(['LOW', 'MEDIUM', 'HIGH', 'CRITICAL']) AS p, unnest(['#36a64f', '#daa038', '#ff6b35', '#cc0000']) AS color) c ON c.p = t.priority""",
    "incident_chain": """
SELECT a.id AS alert_id, t.id AS ticket_id, a.rule_id, a.status AS alert_status, t.status AS ticket_status,
  coalesce(o.n, 0) AS notifications, coalesce(o.failed, 0) AS failed,
  CASE WHEN r.id IS NULL THEN 'rule missing' WHEN o.n IS NULL THEN 'not notified' ELSE 'complete' END AS link
FROM alerts a JOIN tickets t ON t.alert_id = a.id LEFT JOIN rules r ON r.id = a.rule_id
LEFT JOIN (SELECT ticket_id, count(*) AS n, count(*) FILTER (NOT success) AS failed FROM outcomes GROUP BY ticket_id) o ON o.ticket_id = t.id""",
    "alert_sla": """
SELECT severity, count(*) AS n, count(ack_minutes) AS acknowledged, avg(ack_minutes) AS avg_ack_minutes, max(ack_minutes) AS max_ack_minutes,
  count(resolve_minutes) AS resolved, avg(resolve_minutes) AS avg_resolve_minutes, quantile_disc(resolve_minutes, 0.5) AS p50_resolve_minutes
FROM alerts GROUP BY severity""",
    "analysis_batches": """
SELECT source_id, r // 100 AS batch_no, r % 100 + 1 AS pos, log_id, CAST(NULL AS VARCHAR) AS summary
FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY ts DESC, log_id) - 1 AS r FROM logs)
UNION ALL SELECT id, 0, 0, NULL, 'No data to analyze' FROM sources WHERE id NOT IN (SELECT source_id FROM logs)""",
    "render_context": """
SELECT form, source_id, (r - 1) // size AS batch_no, CAST(count(*) AS INTEGER) AS lines, string_agg(line, chr(10) ORDER BY r) AS context FROM (
  SELECT 'short' AS form, source_id, '[' || upper(level) || '] ' || log_id || ': ' || message AS line,
    row_number() OVER (PARTITION BY source_id ORDER BY ts DESC, log_id) AS r, 100 AS size FROM logs
  UNION ALL SELECT 'timed', source_id, '[' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '] [' || upper(level) || '] ' || log_id || ': ' || message,
    row_number() OVER (PARTITION BY source_id ORDER BY ts DESC, log_id), 50 FROM logs
  UNION ALL SELECT 'texts', source_id, '[' || upper(level) || '] ' || log_id || ': '
      || message,
    row_number() OVER (PARTITION BY source_id ORDER BY log_id), 20 FROM leveled)
GROUP BY ALL""",
    "parse_responses": """
SELECT analysis_id, severity, summary, health_score, CASE WHEN form IN (0, 1) THEN 2 ELSE 0 END AS n_anomalies,
  CASE WHEN form IN (0, 1) THEN 1 ELSE 0 END AS n_patterns,
  CASE WHEN form IN (0, 1) THEN 'check ' || o_orderpriority || ',rotate' ELSE '' END AS recommendations,
  CASE WHEN form IN (3, 4) THEN summary END AS error FROM analyses""",
    "anomalies_flat": """
SELECT a.analysis_id, a.pos, a.log_id, a.type, CAST(a.confidence AS DOUBLE) AS confidence, a.description, a.suggested_action, l.level AS log_level
FROM anomalies a JOIN logs l ON l.log_id = a.log_id""",
    "patterns_flat": """
SELECT analysis_id, 0 AS pos, 'p' || (o_custkey % 7) AS pattern, o_custkey % 50 AS occurrences,
  CASE WHEN o_custkey % 50 > 30 THEN 'high' ELSE 'low' END AS significance, unnest([log_id, other_id]) AS log_id
FROM replies WHERE form IN (0, 1)""",
    "summary_severity": """
SELECT CASE WHEN health_score >= 80 THEN 'healthy' WHEN health_score >= 50 THEN 'warning' ELSE 'critical' END AS severity,
  count(*) AS n, min(health_score) AS lowest, max(health_score) AS highest FROM analyses GROUP BY 1""",
    "summarize_window": """
SELECT source_id, CAST(sum(n) AS BIGINT) AS total, CAST(sum(CASE WHEN level IN ('error', 'fatal') THEN n ELSE 0 END) AS BIGINT) AS errors,
  string_agg(level || '=' || n, ';' ORDER BY level) AS levels, min(a) AS start_ts, max(b) AS end_ts, CAST((sum(n) + 499) // 500 AS BIGINT) AS pieces, CAST(sum(n) AS BIGINT) AS shown
FROM (SELECT source_id, level, count(*) AS n, min(ts) AS a, max(ts) AS b FROM logs, clock WHERE ts >= now - INTERVAL 72 HOUR GROUP BY ALL) GROUP BY source_id""",
    "rca_context": """
SELECT 'shown' AS part, log_id, (row_number() OVER (PARTITION BY source_id ORDER BY ts DESC, log_id) - 1) // 200 AS piece,
  CAST(NULL AS BIGINT) AS rows, CAST(NULL AS BIGINT) AS errors FROM around
UNION ALL SELECT 'around', f.log_id, NULL, count(*), count(*) FILTER (l.level IN ('error', 'fatal'))
FROM logs f JOIN logs l ON l.ts BETWEEN f.ts - INTERVAL 5 MINUTE AND f.ts + INTERVAL 5 MINUTE WHERE f.level = 'fatal' GROUP BY f.log_id""",
    "score_batches": """
SELECT 'batch-' || source_id || '-' || (r // 100) AS analysis_id, source_id, CAST(sum(bad) AS BIGINT) || ' of ' || count(*) || ' lines are errors' AS summary,
  CAST(round_even(100 * (1 - sum(bad) / count(*)), 0) AS DOUBLE) AS score
FROM (SELECT source_id, CAST(level IN ('error', 'fatal') AS INTEGER) AS bad,
        row_number() OVER (PARTITION BY source_id ORDER BY ts DESC, log_id) - 1 AS r FROM logs) GROUP BY source_id, r // 100
UNION ALL SELECT 'single-' || log_id, source_id, 'Level: ' || level, CASE WHEN level IN ('error', 'fatal') THEN 0.9 ELSE 0.1 END FROM logs""",
    "rca_results": """
SELECT 'rca' || c_custkey AS analysis_id, CASE WHEN c >= 0.7 THEN 'critical' ELSE 'warning' END AS severity, CAST(c AS DOUBLE) AS confidence,
  CASE WHEN k < 2 THEN 'Root cause analysis completed' ELSE c_mktsegment END AS summary,
  CASE WHEN k < 2 THEN '' ELSE 'n' || c_nationkey || ',db' END AS components, CASE WHEN k < 2 THEN '' ELSE 'fix ' || c_custkey END AS fixes,
  CASE WHEN k < 2 THEN 'shallow' ELSE 'deep' END AS analysis_depth
FROM (SELECT *, c_custkey % 5 AS k, CASE c_custkey % 5 WHEN 0 THEN 0.9 WHEN 1 THEN 0.0 ELSE (c_custkey % 10) / 10.0 END AS c FROM customer)""",
    "analysis_history": """
SELECT analysis_id, created_at, severity FROM analyses WHERE source_id = 'src4' AND analysis_type = 'summary' ORDER BY created_at DESC, analysis_id LIMIT 20""",
    "analysis_report": """
SELECT section, name, n, CAST(NULL AS DOUBLE) AS share, CAST(rank() OVER (PARTITION BY section ORDER BY n DESC) AS INTEGER) AS rank FROM (
  SELECT 'severity' AS section, severity AS name, count(*) AS n FROM analyses GROUP BY ALL
  UNION ALL SELECT 'anomaly', description, count(*) FROM anomalies GROUP BY ALL
  UNION ALL SELECT 'recommendation', r, count(*) FROM (
    SELECT unnest(['check ' || o_orderpriority, 'rotate']) AS r FROM replies WHERE form IN (0, 1)) GROUP BY ALL)
UNION ALL SELECT 'latest', analysis_id || ' ' || severity || ' ' || summary, duration_ms, NULL, NULL FROM (
  SELECT * FROM analyses WHERE analysis_type = 'batch' ORDER BY created_at DESC, analysis_id LIMIT 5)
UNION ALL SELECT 'coverage', 'analysed', count(*) FILTER (log_id IN (SELECT log_id FROM replies)),
  count(*) FILTER (log_id IN (SELECT log_id FROM replies)) / count(*), NULL FROM logs""",
    "error_spikes": """
WITH RECURSIVE cells AS (
  SELECT source_id, time_bucket(INTERVAL 6 HOUR, ts) AS bucket_start, count(*) AS n, count(*) FILTER (level IN ('error', 'fatal')) AS errors FROM logs GROUP BY 1, 2),
grid AS (SELECT source_id, unnest(generate_series(min(bucket_start), max(bucket_start), INTERVAL 6 HOUR)) AS bucket_start FROM cells GROUP BY source_id),
filled AS (SELECT source_id, bucket_start, coalesce(n, 0) AS n, coalesce(errors, 0) AS errors FROM grid LEFT JOIN cells USING (source_id, bucket_start))
SELECT source_id, bucket_start, n, errors, s / c AS mean, sqrt((c * q - s * s) / (c * (c - 1))) AS deviation FROM (
  SELECT *, CAST(count(*) OVER w AS DOUBLE) AS c, CAST(sum(errors) OVER w AS DOUBLE) AS s, CAST(sum(errors * errors) OVER w AS DOUBLE) AS q FROM filled
  WINDOW w AS (PARTITION BY source_id ORDER BY bucket_start ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING))
WHERE c >= 2 AND errors >= 3 AND errors > s / c + 2.0 * sqrt((c * q - s * s) / (c * (c - 1)))""",
    "mine_patterns": """
SELECT template, n AS occurrences, n / t AS share, CASE WHEN n / t >= 0.1 THEN 'high' WHEN n / t >= 0.01 THEN 'medium' ELSE 'low' END AS significance
FROM (SELECT template, count(*) AS n FROM templates GROUP BY template),
  (SELECT count(*) AS t FROM templates)""",
    "pattern_logs": "SELECT template, log_id FROM templates",
    "detect_bursts": """
SELECT source_id, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n FROM (
  SELECT *, sum(new) OVER (PARTITION BY source_id ORDER BY ts) AS run FROM (
    SELECT source_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY source_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM logs))
GROUP BY source_id, run HAVING count(*) >= 3""",
    "rca_timeline": """
SELECT log_id, ts, level, CASE WHEN row_number() OVER (ORDER BY ts, log_id) = 1 THEN 'trigger'
  WHEN row_number() OVER (ORDER BY ts DESC, log_id DESC) = 1 THEN 'result' ELSE 'symptom' END AS significance
FROM around WHERE level IN ('error', 'fatal')""",
    "affected_components": """
SELECT source_id, server_id, count(*) AS n, count(*) FILTER (level IN ('error', 'fatal')) AS errors,
  count(*) FILTER (level IN ('error', 'fatal')) / count(*) AS error_share FROM around GROUP BY ALL HAVING errors > 0""",
    "health_scores": """
SELECT source_id, bucket_start, n, score AS health_score, CASE WHEN score >= 80 THEN 'healthy' WHEN score >= 50 THEN 'warning' ELSE 'critical' END AS severity FROM (
  SELECT source_id, bucket_start, n, CAST(floor(100.0 * (1 - weighted / (4 * n)) + 0.5) AS INTEGER) AS score FROM (
    SELECT source_id, time_bucket(INTERVAL 1 DAY, ts) AS bucket_start, count(*) AS n,
      CAST(sum(CASE level WHEN 'fatal' THEN 4 WHEN 'error' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END) AS BIGINT) AS weighted FROM logs GROUP BY 1, 2))""",
    "stream_tumbling": """
SELECT bucket_start, source_id, n, errors FROM (
  SELECT time_bucket(INTERVAL 3 HOUR, ts) AS bucket_start, source_id, count(*) AS n, count(*) FILTER (level IN ('error', 'fatal')) AS errors FROM logs GROUP BY 1, 2), clock
WHERE bucket_start + INTERVAL 3 HOUR <= now - INTERVAL 10 MINUTE""",
    "stream_rules": f"""
WITH RECURSIVE runs AS (SELECT * FROM met_runs WHERE {_NO_AI})
SELECT rule_id, t AS as_of, triggered FROM (
  SELECT rule_id, first AS step, true AS triggered FROM runs UNION ALL SELECT rule_id, last + 1, false FROM runs
  UNION ALL SELECT id, 0, false FROM rules WHERE status = 'enabled' AND id NOT IN (SELECT rule_id FROM runs WHERE first = 0)
) JOIN ticks USING (step) WHERE step <= {_HORIZON}""",
    "stream_sessions": """
SELECT source_id, start_ts, end_ts, n FROM (
  SELECT source_id, min(ts) AS start_ts, max(ts) + INTERVAL 30 MINUTE AS end_ts, count(*) AS n FROM (
    SELECT *, sum(new) OVER (PARTITION BY source_id ORDER BY ts) AS run FROM (
      SELECT source_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY source_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM logs))
  GROUP BY source_id, run), clock WHERE end_ts <= now - INTERVAL 10 MINUTE""",
    "stream_cooldown": _KEPT + f"""
SELECT rule_id, t AS triggered_at FROM kept JOIN ticks USING (step) WHERE step <= {_HORIZON} AND {_NO_AI}""",
    "stream_silence": """
SELECT source_id, CASE WHEN seen THEN ts END AS last_ts, ts + INTERVAL 30 MINUTE AS as_of FROM (
  SELECT *, lead(ts) OVER (PARTITION BY source_id ORDER BY ts, seen) AS later FROM (
    SELECT source_id, ts, true AS seen FROM logs UNION ALL SELECT id, (SELECT min(ts) FROM logs), false FROM sources)),
  (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM logs)
WHERE (later > ts + INTERVAL 30 MINUTE AND time_bucket(INTERVAL 1 MINUTE, later) + INTERVAL 1 MINUTE <= mark)
  OR (coalesce(later > ts + INTERVAL 30 MINUTE, true) AND ts + INTERVAL 31 MINUTE <= mark)""",
    "stream_source_refresh": """
SELECT l.log_id AS message_id, coalesce(s.source_id, 'unregistered:10.1.0.' || l.user_id) AS source_id, s.server_id
FROM logs l LEFT JOIN senders s ON s.ip = '10.1.0.' || l.user_id""",
    "sink_round_trip": """
SELECT log_id, source_id, level, message, ts, strftime(ts, '%Y-%m-%d') AS day FROM logs
WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-15 00:00:00'""",
    "rule_loop": """
WITH RECURSIVE times AS (SELECT i, step, t FROM (SELECT i, k - 60 + 30 * i AS step FROM (SELECT max(step) AS k FROM ticks), (SELECT unnest([0, 1, 2]) AS i)) JOIN ticks USING (step)),
asked AS (SELECT r.id AS rule_id, r.cooldown_minutes AS cd, x.i, x.t, r.last_triggered_at AS stored, r.trigger_count AS counted,
    EXISTS (SELECT 1 FROM met_ticks m WHERE m.rule_id = r.id AND m.step = x.step) AS met FROM rules r, times x),
walk AS (
  SELECT rule_id, i, t, met AND NOT coalesce(t < stored + to_minutes(cd), false) AS fired,
    CASE WHEN met AND NOT coalesce(t < stored + to_minutes(cd), false) THEN greatest(stored, t) ELSE stored END AS last FROM asked WHERE i = 0
  UNION ALL SELECT a.rule_id, a.i, a.t, a.met AND NOT coalesce(a.t < w.last + to_minutes(a.cd), false),
    CASE WHEN a.met AND NOT coalesce(a.t < w.last + to_minutes(a.cd), false) THEN greatest(w.last, a.t) ELSE w.last END FROM walk w JOIN asked a ON a.rule_id = w.rule_id AND a.i = w.i + 1),
behind AS (SELECT w.rule_id, w.i, count(DISTINCT l.log_id) AS n FROM walk w JOIN conds c ON c.rule_id = w.rule_id
  JOIN logs l ON (c.source_id IS NULL OR l.source_id = c.source_id) AND l.ts BETWEEN w.t - to_minutes(c.w) AND w.t
  WHERE w.fired AND (list_contains(c.levels, l.level) OR len(list_filter(c.keywords, lambda k: contains(lower(l.message), lower(k)))) > 0) GROUP BY ALL)
SELECT 'alert' AS kind, w.rule_id, w.t AS at, coalesce(b.n, 0) AS n, upper(r.severity) AS priority FROM walk w JOIN rules r ON r.id = w.rule_id LEFT JOIN behind b USING (rule_id, i) WHERE w.fired
UNION ALL SELECT 'state', a.rule_id, w.last, a.counted + (SELECT count(*) FROM walk x WHERE x.rule_id = a.rule_id AND x.fired), NULL
FROM asked a JOIN walk w ON w.rule_id = a.rule_id AND w.i = 2 WHERE a.i = 2""",
    "analysis_job": """
SELECT run || '-' || source_id || '-' || (r // 100) AS analysis_id, source_id, CAST(sum(bad) AS BIGINT) || ' of ' || count(*) || ' lines are errors' AS summary,
  CAST(round_even(100 * (1 - sum(bad) / count(*)), 0) AS INTEGER) AS health_score, count(*) AS n_logs
FROM (SELECT *, row_number() OVER (PARTITION BY run, source_id ORDER BY ts DESC, log_id) - 1 AS r FROM (
  SELECT source_id, log_id, ts, CAST(level IN ('error', 'fatal') AS INTEGER) AS bad, CASE WHEN ts < TIMESTAMP '2024-01-15' THEN 'first' ELSE 'second' END AS run FROM logs))
GROUP BY run, source_id, r // 100
UNION ALL SELECT 'open', NULL, NULL, NULL, 0""",
    "stream_dedupe": "SELECT log_id, source_id, level, ts FROM logs",
    "usage_metering": "SELECT * FROM usage",
    "quota_check": """
SELECT u.organization_id, u.period, o.plan, u.bytes_ingested / 1000000000.0 > CASE o.plan WHEN 'free' THEN 0.5 WHEN 'starter' THEN 5.0 ELSE 50.0 END AS over_ingestion,
  coalesce(u.analyses_run > CASE o.plan WHEN 'free' THEN 10 WHEN 'starter' THEN 100 END, false) AS over_analyses,
  coalesce(o.rules > CASE o.plan WHEN 'free' THEN 3 WHEN 'starter' THEN 20 END, false) AS over_rules,
  o.users > CASE o.plan WHEN 'free' THEN 1 WHEN 'starter' THEN 3 ELSE 10 END AS over_users,
  CAST(greatest(u.bytes_ingested / 1000000000.0 - CASE o.plan WHEN 'free' THEN 0.5 WHEN 'starter' THEN 5.0 ELSE 50.0 END, 0) * 0.5 AS DOUBLE) AS overage_price
FROM usage u JOIN orgs o ON o.organization_id = u.organization_id""",
    "retention": """
SELECT l.organization_id, count(*) AS kept, min(l.ts) AS oldest FROM tenant_logs l LEFT JOIN orgs o ON o.organization_id = l.organization_id, clock
WHERE o.plan IS NULL OR l.ts >= now - to_days(CASE o.plan WHEN 'free' THEN 1 WHEN 'starter' THEN 7 ELSE 30 END) GROUP BY l.organization_id""",
    "tenant_scope": "SELECT log_id, source_id, organization_id, level FROM tenant_logs WHERE organization_id = 'org15'",
    "severity_heatmap": """
SELECT CAST(hour(created_at) AS INTEGER) AS hour, count(*) FILTER (severity = 'low') AS low, count(*) FILTER (severity = 'medium') AS medium,
  count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'critical') AS critical FROM alerts GROUP BY 1""",
}

ORACLES: dict[str, str] = {name: _with(body) for name, body in BODIES.items()}
