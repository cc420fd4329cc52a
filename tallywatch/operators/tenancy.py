"""Per-organisation scope, usage, quotas, retention, and the severity heat map."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywatch import schemas
from tallywatch.functions.timing import as_ntz

# Plan limits; null means unlimited. Extra gigabytes cost the overage price.
PLANS = [
    ("free", 0.5, 10, 3, 1, 1),
    ("starter", 5.0, 100, 20, 3, 7),
    ("pro", 50.0, None, None, 10, 30),
    ("enterprise", None, None, None, None, 90),
]
OVERAGE_PER_GB = 0.50
UNOWNED = "unowned"
BYTES_PER_GB = 1_000_000_000


def plan_value(plan: Column, index: int, kind: str) -> Column:
    """Limit number ``index`` of a plan, as an expression (the plan list is fixed)."""
    chain = None
    for row in PLANS:
        value = F.lit(row[index]).cast(kind)
        chain = F.when(plan == row[0], value) if chain is None else chain.when(plan == row[0], value)
    return chain


def tenant_scope(df: DataFrame, org_id: str) -> DataFrame:
    """Only the rows of one organisation."""
    return df.filter(F.col("organization_id") == org_id)


def with_organization(df: DataFrame, sources: DataFrame) -> DataFrame:
    """Add the organisation that owns each row's source; rows of unregistered sources are ``unowned``."""
    owner = sources.select(F.col("id").alias("source_id"), F.col("owner_id").alias("organization_id"))
    return df.join(owner, "source_id", "left").withColumn(
        "organization_id", F.coalesce("organization_id", F.lit(UNOWNED)))


def usage_metering(logs: DataFrame, analyses: DataFrame, sources: DataFrame) -> DataFrame:
    """Bytes and logs ingested and analyses run, per organisation and month.

    Bytes are the stored raw text, or the message where no raw text was kept. Rows
    are summed per source before the owner is looked up, so only sums are joined.
    """
    raw = F.col("raw_content") if "raw_content" in logs.columns else F.lit(None).cast("string")
    size = F.octet_length(F.coalesce(raw, F.col("message")))
    month, zero = "yyyy-MM", F.lit(0).cast("long")
    stored = logs.groupBy("source_id", F.date_format("ts", month).alias("period")).agg(
        F.sum(size).cast("long").alias("bytes_ingested"), F.count("*").alias("logs_ingested"),
        zero.alias("analyses_run"))
    runs = analyses.groupBy("source_id", F.date_format("created_at", month).alias("period")).agg(
        zero.alias("bytes_ingested"), zero.alias("logs_ingested"), F.count("*").alias("analyses_run"))
    owned = with_organization(stored.unionByName(runs), sources)
    return owned.groupBy("organization_id", "period").agg(*[
        F.sum(c).alias(c) for c in ("bytes_ingested", "logs_ingested", "analyses_run")])


def quota_check(usage: DataFrame, organizations: DataFrame) -> DataFrame:
    """Usage against the plan of each organisation ``(organization_id, plan, rules, users)``."""
    joined = usage.join(organizations, "organization_id")
    plan = F.col("plan")
    gb = F.col("bytes_ingested") / F.lit(float(BYTES_PER_GB))
    extra = F.greatest(gb - plan_value(plan, 1, "double"), F.lit(0.0))

    def over(used: Column, index: int) -> Column:
        return F.coalesce(used > plan_value(plan, index, "long"), F.lit(False))

    return joined.select(
        "organization_id", "period", "plan",
        (F.coalesce(extra, F.lit(0.0)) > 0).alias("over_ingestion"),
        over(F.col("analyses_run"), 2).alias("over_analyses"),
        over(F.col("rules"), 3).alias("over_rules"), over(F.col("users"), 4).alias("over_users"),
        (F.coalesce(extra, F.lit(0.0)) * OVERAGE_PER_GB).alias("overage_price"),
    )


def apply_retention(logs: DataFrame, organizations: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Logs young enough for their organisation's plan.

    What cannot be judged is kept: logs of unknown organisations, and of unknown or missing plans.
    """
    days = plan_value(F.col("plan"), 5, "int")
    plans = organizations.select("organization_id", "plan")
    young = F.col("ts") >= as_ntz(as_of) - F.make_dt_interval(days)
    return logs.join(plans, "organization_id", "left").filter(days.isNull() | young).drop("plan")


def severity_heatmap(alerts: DataFrame) -> DataFrame:
    """Alerts per hour of day and severity."""
    return alerts.groupBy(F.hour("created_at").alias("hour")).pivot(
        "severity", schemas.ALERT_SEVERITIES).agg(F.count(F.lit(1))).na.fill(0)
