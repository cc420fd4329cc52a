"""Table schemas and enumerations."""

from __future__ import annotations

from pyspark.sql import types as T

# The enumerations of the data model.
LOG_FORMATS = ["json", "syslog", "plain", "custom"]
SOURCE_TYPES = [
    "zabbix", "prometheus", "custom", "file", "api",
    "syslog", "webhook", "datadog", "elasticsearch", "splunk",
]
SOURCE_STATUSES = ["online", "offline", "unknown"]
SERVER_STATUSES = ["active", "inactive", "maintenance"]
CONDITION_TYPES = [
    "error_count", "error_rate", "log_level", "keyword_match", "ai_anomaly", "no_logs", "custom",
]
RULE_STATUSES = ["enabled", "disabled", "testing"]
ALERT_SEVERITIES = ["low", "medium", "high", "critical"]
ALERT_STATUSES = ["active", "acknowledged", "resolved", "silenced"]
TICKET_STATUSES = ["OPEN", "IN_PROGRESS", "RESOLVED", "CLOSED"]
TICKET_PRIORITIES = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
ANOMALY_TYPES = [
    "error_spike", "unusual_pattern", "security_concern", "performance_issue",
    "system_failure", "configuration_error", "resource_exhaustion", "unknown",
]
OVERALL_SEVERITIES = ["healthy", "warning", "critical", "unknown"]

STR_MAP = T.MapType(T.StringType(), T.StringType())

LOGS = T.StructType([
    T.StructField("log_id", T.StringType()),
    T.StructField("source_id", T.StringType()),
    T.StructField("server_id", T.StringType()),
    T.StructField("level", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("raw_content", T.StringType()),
    T.StructField("format", T.StringType()),
    T.StructField("metadata", STR_MAP),
    T.StructField("ts", T.TimestampNTZType()),
])

LOG_ENTRY = T.StructType([
    T.StructField("level", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("metadata", STR_MAP),
    T.StructField("timestamp", T.StringType()),
])

BULK_ENVELOPE = T.StructType([
    T.StructField("sourceId", T.StringType()),
    T.StructField("serverId", T.StringType()),
    T.StructField("format", T.StringType()),
    T.StructField("logs", T.ArrayType(LOG_ENTRY)),
])

SINGLE_ENVELOPE = T.StructType(
    [
        T.StructField("sourceId", T.StringType()),
        T.StructField("serverId", T.StringType()),
        T.StructField("format", T.StringType()),
    ]
    + LOG_ENTRY.fields
)

SOURCE_CONFIG = T.StructType([
    T.StructField("syslogIp", T.StringType()),
    T.StructField("syslogIps", T.ArrayType(T.StringType())),
    T.StructField("ip", T.StringType()),
    T.StructField("serverId", T.StringType()),
    T.StructField("pullEnabled", T.StringType()),
    T.StructField("pullIntervalMs", T.LongType()),
    T.StructField("pullMethod", T.StringType()),
    T.StructField("filePath", T.StringType()),
    T.StructField("httpUrl", T.StringType()),
    T.StructField("format", T.StringType()),
])

# ``levels`` is read as text because it may be an array or a comma list.
CONDITIONS = T.ArrayType(T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("params", T.StructType([
        T.StructField("threshold", T.DoubleType()),
        T.StructField("timeWindowMinutes", T.DoubleType()),
        T.StructField("levels", T.StringType()),
        T.StructField("keywords", T.ArrayType(T.StringType())),
        T.StructField("matchAll", T.BooleanType()),
        T.StructField("minConfidence", T.DoubleType()),
        T.StructField("anomalyTypes", T.ArrayType(T.StringType())),
    ])),
]))

ACTIONS = T.ArrayType(T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("config", STR_MAP),
]))

ANOMALIES = T.ArrayType(T.StructType([
    T.StructField("logId", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("description", T.StringType()),
    T.StructField("suggestedAction", T.StringType()),
]))

PATTERNS = T.ArrayType(T.StructType([
    T.StructField("pattern", T.StringType()),
    T.StructField("occurrences", T.LongType()),
    T.StructField("logIds", T.ArrayType(T.StringType())),
    T.StructField("significance", T.StringType()),
    T.StructField("description", T.StringType()),
]))

BATCH_REPLY = T.StructType([
    T.StructField("anomalies", ANOMALIES),
    T.StructField("patterns", PATTERNS),
    T.StructField("severity", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("recommendations", T.ArrayType(T.StringType())),
    T.StructField("keyEvents", T.ArrayType(T.StringType())),
    T.StructField("topIssues", T.ArrayType(T.StringType())),
    T.StructField("healthScore", T.IntegerType()),
])

SINGLE_REPLY = T.StructType([
    T.StructField("isAnomaly", T.BooleanType()),
    T.StructField("anomalyType", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("explanation", T.StringType()),
    T.StructField("suggestedActions", T.ArrayType(T.StringType())),
    T.StructField("relatedConcepts", T.ArrayType(T.StringType())),
])

ROOT_CAUSE_REPLY = T.StructType([
    T.StructField("probableCauses", T.ArrayType(T.StructType([
        T.StructField("cause", T.StringType()),
        T.StructField("probability", T.DoubleType()),
        T.StructField("evidence", T.ArrayType(T.StringType())),
        T.StructField("logIds", T.ArrayType(T.StringType())),
    ]))),
    T.StructField("timeline", T.ArrayType(T.StructType([
        T.StructField("timestamp", T.StringType()),
        T.StructField("event", T.StringType()),
        T.StructField("logId", T.StringType()),
        T.StructField("significance", T.StringType()),
    ]))),
    T.StructField("affectedComponents", T.ArrayType(T.StringType())),
    T.StructField("recommendedFixes", T.ArrayType(T.StringType())),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("analysisDepth", T.StringType()),
])

ALERTMANAGER = T.StructType([
    T.StructField("alerts", T.ArrayType(T.StructType([
        T.StructField("status", T.StringType()),
        T.StructField("startsAt", T.StringType()),
        T.StructField("labels", STR_MAP),
        T.StructField("annotations", STR_MAP),
    ]))),
])

ZABBIX = T.StructType([
    T.StructField(name, T.StringType())
    for name in ["host", "trigger", "severity", "subject", "message", "eventId"]
])

DATADOG = T.StructType([
    T.StructField("level", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("metadata", STR_MAP),
])
